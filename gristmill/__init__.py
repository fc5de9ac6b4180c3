"""Dataset curation and robustness-evaluation analytics on Spark DataFrames."""
