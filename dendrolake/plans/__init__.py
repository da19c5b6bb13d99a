"""Declarative plans: one SQL text for each operator, run by Spark over DataFrames."""
