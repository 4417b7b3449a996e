"""Whole studies composed of operators; every result is a DataFrame in long form."""
