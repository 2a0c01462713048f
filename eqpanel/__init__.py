"""Panel analytics on Spark DataFrames: every operator is a lazy DataFrame function."""
