"""Record linkage and register migration on Spark DataFrames."""
