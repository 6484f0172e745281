"""Scalar, window and aggregate functions of the language, each a composition of built-in column functions."""

from pipewright.functions import arrays, bags, maths, net, series, strings, times  # noqa: F401  (they register themselves)
from pipewright.functions.base import FUNCTIONS, QueryError, Val, build

__all__ = ["FUNCTIONS", "QueryError", "Val", "build"]
