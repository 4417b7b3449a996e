"""Training-data operators: ten self-contained building blocks for text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
returns DataFrames and keeps working when input columns carry extra names.
"""
