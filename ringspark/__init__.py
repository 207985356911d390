"""ringspark: circular-key analytics on Spark DataFrames."""
