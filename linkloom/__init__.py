"""linkloom: record linkage and large-table analytics, planned as Spark DataFrames."""

__version__ = "0.1.0"
