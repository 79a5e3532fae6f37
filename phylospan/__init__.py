"""Hierarchical sequence classification and tree-shaped analytics on Spark DataFrames."""
