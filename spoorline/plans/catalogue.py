"""Imports every query module so that the registry is complete."""

from spoorline.plans import attack_queries, feature_queries, graph_queries, metric_queries, prep_queries, record_queries, stream_queries, vector_queries  # noqa: F401
from spoorline.plans.registry import ORACLES, QUERIES  # noqa: F401
