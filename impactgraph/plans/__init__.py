"""plans of the impact engine."""
