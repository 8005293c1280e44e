"""terraloom: vector geospatial data on PySpark DataFrames."""

__version__ = "0.1.0"
