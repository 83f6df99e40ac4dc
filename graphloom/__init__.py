"""Graph and retrieval analytics on Spark DataFrames."""
