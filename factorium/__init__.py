"""Factor-graph analytics on Spark: typed measurement graphs as DataFrames."""
