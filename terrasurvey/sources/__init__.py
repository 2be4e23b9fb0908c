"""Sources of the survey library."""
