"""Queries over the given tables and the SQL they are checked against."""

from suite.registry import ORACLES, QUERIES  # noqa: F401
from suite import text_queries, ingest_queries, retrieval_queries, quality_queries  # noqa: F401
