"""Inputs derived from the given tables, and whole workflows composed of operators."""
