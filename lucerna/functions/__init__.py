"""Blank-aware scalar functions as Column expressions."""
