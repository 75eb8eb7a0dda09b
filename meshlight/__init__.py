"""A structural graph analytics engine on Spark DataFrames."""
