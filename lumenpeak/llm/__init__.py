"""Operators that prepare text for language model training, on DataFrames."""
