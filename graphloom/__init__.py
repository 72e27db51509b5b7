"""Typed property-graph analytics on Spark DataFrames."""
