"""Signal discovery and table operators for Spark DataFrames."""
