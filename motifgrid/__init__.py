"""motifgrid: structural-alphabet search, scoring and evaluation on Spark DataFrames."""
