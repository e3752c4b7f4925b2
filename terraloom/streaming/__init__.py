"""streaming of the spatial library."""
