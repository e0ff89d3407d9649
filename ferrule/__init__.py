"""ferrule: discovery analytics over code and text tables, on PySpark DataFrames."""

__version__ = "0.1.0"
