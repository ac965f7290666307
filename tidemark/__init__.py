"""Event-tape analytics on Spark DataFrames."""
