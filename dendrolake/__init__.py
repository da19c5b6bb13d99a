"""Dated-tree, alignment and trace analytics expressed as Spark DataFrames."""
