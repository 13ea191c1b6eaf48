"""Learned table statistics on Spark: fit a compact probabilistic model of a table and answer queries from it."""
