"""loomgraph.functions"""
