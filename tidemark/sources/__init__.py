"""Readers of feeds, sitemaps, robots rules and pages."""
