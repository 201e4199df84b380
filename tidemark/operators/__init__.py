"""Jobs: lazy functions from DataFrames to a DataFrame, with column names as parameters."""
