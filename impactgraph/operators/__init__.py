"""operators of the impact engine."""
