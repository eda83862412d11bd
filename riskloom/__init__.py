"""URL risk analytics on Spark DataFrames."""
