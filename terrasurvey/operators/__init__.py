"""Operators of the survey library."""
