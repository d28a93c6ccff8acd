"""Partitioning strategies, the primitives under them, and what reports on them."""
