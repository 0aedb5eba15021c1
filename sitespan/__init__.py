"""Web-site audit analytics on Spark DataFrames."""
