"""Queries by name, with their oracles."""
