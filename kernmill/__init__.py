"""A PySpark engine for kernel density evaluation and the analytics around it."""

__version__ = "0.1.0"
