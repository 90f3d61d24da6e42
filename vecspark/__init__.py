"""vecspark: vector analytics on Spark DataFrames."""
