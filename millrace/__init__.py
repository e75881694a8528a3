"""millrace: retrieval analytics on Spark DataFrames."""
