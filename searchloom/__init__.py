"""Document-retrieval and index analytics on Spark DataFrames."""
