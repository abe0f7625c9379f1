"""Counting rules as Column builders, and pure rules without Spark."""
