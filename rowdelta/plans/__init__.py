"""Query plans made of the operators."""

from .diff import SparkDiffer, diff

__all__ = ["SparkDiffer", "diff"]
