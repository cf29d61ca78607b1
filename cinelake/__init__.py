"""Media and signal analytics on Spark DataFrames."""
