"""sources of the spatial library."""
