"""Queries over the test tables; importing this package registers them all."""

from tallyloom.plans import (  # noqa: F401
    aggregate_queries,
    function_queries,
    graph_queries,
    ml_queries,
    relational_queries,
    reshape_queries,
    scan_queries,
    series_queries,
    stats_queries,
    text_queries,
    window_queries,
)
from tallyloom.plans.registry import REGISTRY, Query  # noqa: F401
