"""Document and code-structure analytics on Spark DataFrames."""
