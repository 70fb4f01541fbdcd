"""Semantic models, filter contexts and table operators."""
