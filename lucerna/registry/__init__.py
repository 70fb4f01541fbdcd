"""Registered queries by subject, each module with its SQL."""
