"""Operators for preparing large text corpora, each a Spark job of its own."""
