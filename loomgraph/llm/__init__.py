"""Operators for training-data pipelines. Nothing else in loomgraph imports this package."""
