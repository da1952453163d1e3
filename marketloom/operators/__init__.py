"""operators of marketloom."""
