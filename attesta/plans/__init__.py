"""Registered queries and the SQL that each is checked against."""

from . import checks, more, retrieval, streams, written
from .registry import ORACLE_SQL, QUERIES
from .retrieval import search

__all__ = ["ORACLE_SQL", "QUERIES", "checks", "more", "retrieval", "search", "streams", "written"]
