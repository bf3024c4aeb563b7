"""Driver adapters: each registered query applies the operators to the given tables."""

from fleetloom.queries import (  # noqa: F401
    document_queries,
    health_queries,
    node_queries,
    redaction_queries,
    stream_queries,
)
from fleetloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
