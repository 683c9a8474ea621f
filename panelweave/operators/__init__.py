"""Operators over panels: DataFrame in, DataFrame out."""
