"""Operators for preparing training data, and their queries."""

from runloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
