"""parse of the impact engine."""
