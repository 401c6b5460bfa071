"""tidegrid: gridded-feature analytics on Spark DataFrames."""
