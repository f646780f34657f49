"""Streams of grid cells."""
