"""Reverse search on Spark: stored boolean queries are matched against flows of documents."""

from .operators.percolate import match_all, percolate, search
from .operators.store import Percolator, PercolatorError
from .parser import QueryParseError, parse_query
from .plans.config import EngineConfig
from .query import Clause, Literal, Query, field
from .sources.documents import Document

__all__ = ["Clause", "Document", "EngineConfig", "Literal", "Percolator", "PercolatorError", "Query", "QueryParseError", "field", "match_all", "parse_query", "percolate", "search"]
