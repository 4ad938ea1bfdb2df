"""Column functions and metadata helpers."""
