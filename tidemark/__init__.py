"""Time-series analytics over bars, and preparation of training text, on Spark DataFrames."""
