"""Composite queries over the driver tables."""
