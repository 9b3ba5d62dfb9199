"""Operators over entries: search, federation, session memory, similarity joins, diffs, graphs, lifecycles."""
