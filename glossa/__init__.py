"""Dictionary search on Spark: sorted key -> values dictionaries and file archives as DataFrames, searched by composable operators."""

__version__ = "0.1.0"
