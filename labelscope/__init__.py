"""Label-budget and classifier-evaluation analytics over Spark DataFrames."""
