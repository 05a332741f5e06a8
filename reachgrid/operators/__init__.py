"""Relational building blocks: scoring, order statistics, spatial joins, keys."""
