"""sources of loomgraph."""
