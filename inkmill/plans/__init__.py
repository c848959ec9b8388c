"""Queries: what the driver runs, and SQL that computes the same."""
