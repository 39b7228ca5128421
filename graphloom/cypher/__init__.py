"""The query language: text to syntax tree, without Spark."""

from .analysis import analyse
from .parser import parse
from .syntax import CypherSyntaxError

__all__ = ["CypherSyntaxError", "analyse", "parse"]
