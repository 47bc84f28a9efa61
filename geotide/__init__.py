"""geotide: spatio-temporal query operators as lazy Spark DataFrames."""
