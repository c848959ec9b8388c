"""inkmill: document analytics on Spark DataFrames, SQL and Structured Streaming."""
