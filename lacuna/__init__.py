"""Cloze analytics on Spark: corpus statistics, candidate generation and screening."""
