"""Whole tools: screening, smoothing, their reports, and the registry."""
