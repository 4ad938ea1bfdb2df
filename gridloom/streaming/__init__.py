"""Runs of events over a stream."""
