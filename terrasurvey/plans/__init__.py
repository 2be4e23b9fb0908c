"""Plans of the survey library."""
