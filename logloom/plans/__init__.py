"""Registered queries: every operator over log tables derived from the given tables."""
