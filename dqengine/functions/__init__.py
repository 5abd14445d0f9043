"""Column helpers and scalar functions."""
