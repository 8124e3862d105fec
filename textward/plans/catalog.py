"""All registered queries."""

from . import sink_queries, stream_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
