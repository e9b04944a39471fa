"""Document-record analytics on Spark DataFrames."""
