"""sources of the impact engine."""
