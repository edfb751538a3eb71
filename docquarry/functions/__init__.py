"""Column functions and Arrow-backed functions."""
