"""Relational, graph and spatial operators on DataFrames."""
