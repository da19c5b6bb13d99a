"""Numerical functions that Spark has no built-in for."""
