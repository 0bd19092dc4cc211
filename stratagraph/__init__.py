"""A provenance-aware graph of code, configuration and documents, on Spark DataFrames."""
