"""Identity-governance analytics on Spark DataFrames."""
