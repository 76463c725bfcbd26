"""Small area estimation on Spark DataFrames."""
