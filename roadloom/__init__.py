"""roadloom: road-map data processing on Spark DataFrames."""
