"""functions of the impact engine."""
