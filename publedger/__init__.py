"""Public-spending and office-calendar analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
