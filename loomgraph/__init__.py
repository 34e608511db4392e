"""Loomgraph: knowledge-graph integration and evaluation on Spark DataFrames."""
