"""Resampling, climatologies, percentiles, events and regridding."""
