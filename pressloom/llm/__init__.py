"""Operators for training data. Nothing else in the library imports this package."""

from pressloom.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
