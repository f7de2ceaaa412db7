"""A graph-and-provenance analytics engine on Spark DataFrames."""
