"""Queries over the given tables, each next to an independent SQL answer where one exists."""
