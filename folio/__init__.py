"""Text structure, narrative state and dataset operators on Spark DataFrames."""
