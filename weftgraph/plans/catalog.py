"""All registered queries of the library itself."""

from weftgraph.plans import graph_queries, runtime_queries, text_queries  # noqa: F401
from weftgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
