"""Imports every query module, so the registry is complete."""

from filamet.plans import (  # noqa: F401
    campaign_queries,
    distribution_queries,
    image_queries,
    row_rules,
    run_queries,
    sink_queries,
    statistics_queries,
)
from filamet.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
