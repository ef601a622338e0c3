"""Registered queries with their oracles."""
