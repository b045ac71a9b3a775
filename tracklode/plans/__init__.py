"""Composed plans and the catalogue of queries on the fixture tables."""
