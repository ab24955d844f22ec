"""All queries but those of the training-data subpackage, bound to the driver's tables."""

from .registry import MODULE, QUERIES, SQL
from . import assistant, graph, ingest, learn, relational, rerank, routing, search  # noqa: E402,F401

__all__ = ["MODULE", "QUERIES", "SQL"]
