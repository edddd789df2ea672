"""Queries on the shared test tables, each next to the SQL that must give the same rows."""

from . import collecting, matching, tracking  # noqa: F401 - importing registers the queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
