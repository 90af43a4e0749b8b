"""Rendering, command line and request loop of the impact engine."""
