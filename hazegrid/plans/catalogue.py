"""All registered queries."""

from hazegrid.plans import grid_queries, hotspot_queries, index_queries, model_queries, series_queries  # noqa: F401
from hazegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
