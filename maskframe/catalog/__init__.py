"""Registered queries and, where SQL can say the same, their SQL twins."""

from maskframe.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
