"""plans of the spatial library."""
