"""linkweave: large-scale record linkage on Spark DataFrames."""
