"""Readers and writers, and grids derived from tables."""
