"""Cootide: sparse tensors and record-scale data processing as plain Spark DataFrames."""
