"""packsmith: byte-content analytics on Spark DataFrames."""
