"""The query language: tokens, syntax tree and parser.  Nothing here knows Spark."""

from pipewright.lang.parser import parse_query, parse_script

__all__ = ["parse_query", "parse_script"]
