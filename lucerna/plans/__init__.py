"""Retrieval and other composed plans."""
