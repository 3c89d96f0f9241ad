"""Survey analytics on Spark: DataFrames in, DataFrames out."""
