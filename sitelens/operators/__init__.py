"""Operators: DataFrame in, DataFrame out; the logical plan is all they build."""
