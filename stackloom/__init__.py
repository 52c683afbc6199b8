"""A PySpark engine for dense image stacks and the records that describe them."""

__version__ = "0.1.0"
