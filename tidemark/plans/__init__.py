"""Composed checks and the registered queries."""
