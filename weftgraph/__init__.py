"""Build-graph analytics on Spark DataFrames."""
