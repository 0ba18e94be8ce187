"""Palimpsest: document-revision analytics on PySpark DataFrames."""
