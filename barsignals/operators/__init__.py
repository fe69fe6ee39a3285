"""Operators: filters, the skew-safe series layout, indicators, signals, levels,
aggregations, reshaping and joins. Each works on Spark DataFrames only."""
