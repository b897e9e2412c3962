"""Imports every query module, which fills the registry."""

from demandloom.plans import (  # noqa: F401
    check_queries,
    design_queries,
    envelope_queries,
    file_queries,
    geometry_queries,
    metric_queries,
    schedule_queries,
    story_queries,
)
from demandloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
