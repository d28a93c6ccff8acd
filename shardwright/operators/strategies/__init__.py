"""Strategies: each maps a table to ``partition`` and its key columns."""
