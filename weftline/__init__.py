"""weftline: data-processing operations as plain functions from DataFrames to a DataFrame."""
