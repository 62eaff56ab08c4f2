"""Decisions taken from the key graph and the schema alone, before any row is read."""
