"""quarry: a catalog analytics engine expressed as lazy PySpark DataFrames."""

__version__ = "0.1.0"
