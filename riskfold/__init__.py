"""Multi-source risk modelling on PySpark DataFrames."""

__version__ = "0.1.0"
