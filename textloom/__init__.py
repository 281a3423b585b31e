"""Text and event analytics on Spark DataFrames."""
