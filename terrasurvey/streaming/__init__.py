"""Streaming of the survey library."""
