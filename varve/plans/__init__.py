"""The registered queries of the library."""

from . import diagnose_queries, explore_queries, feature_queries, forecast_queries, learn_queries, mining_queries, pipeline_queries, prepare_queries, search_queries, series_queries, signal_queries, source_queries, tracker_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
