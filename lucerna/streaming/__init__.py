"""Structured Streaming counterparts of the event log's operations."""
