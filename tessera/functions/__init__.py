"""Columns: metric, curves, lattices and flow fields."""
