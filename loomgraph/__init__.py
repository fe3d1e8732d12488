"""loomgraph: workspace-graph analytics and corpus processing as Spark jobs."""

__version__ = "0.1.0"
