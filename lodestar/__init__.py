"""Lodestar: code-context retrieval and repository analytics on PySpark DataFrames."""
