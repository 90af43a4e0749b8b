"""streaming of the impact engine."""
