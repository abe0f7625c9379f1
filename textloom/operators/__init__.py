"""Measures: DataFrame in, one row per text out."""
