"""Operators on grids and graphs, as DataFrame transformations."""
