"""Operators composed into pipelines, and the catalogue of queries with their SQL."""
