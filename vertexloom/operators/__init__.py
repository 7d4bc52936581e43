"""Operators on keyed tables and edges."""
