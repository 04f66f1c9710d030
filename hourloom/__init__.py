"""hourloom: panel analytics on Spark DataFrames."""
