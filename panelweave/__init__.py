"""Indicator panels on Spark: assemble, summarise, rank, chart and regress."""
