"""Emberline: burst detection, event clustering and event tracking over short texts, on PySpark."""

__version__ = "0.1.0"
