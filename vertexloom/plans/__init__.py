"""Iterative plans and algorithms."""
