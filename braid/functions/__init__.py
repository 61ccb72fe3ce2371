"""Column functions on vertex sequences."""
