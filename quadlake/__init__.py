"""Shape-described graph queries on Spark DataFrames."""
