"""Functions of the survey library."""
