"""The tabular operators: each takes (lowering, frame, operator, bindings) and returns a frame."""

from pipewright.operators.base import OPERATORS, operator
from pipewright.operators import evaluate, join, parsing, reshape, scan, series, sources, summarize, tabular, top  # noqa: F401  (they register themselves)

__all__ = ["OPERATORS", "operator"]
