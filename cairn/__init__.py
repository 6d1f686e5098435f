"""Text retrieval and its evaluation on Spark DataFrames."""
