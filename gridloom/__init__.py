"""Gridded time-series analytics as DataFrame programs."""
