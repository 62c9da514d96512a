"""All registered queries of the engine."""

from __future__ import annotations

from loamgrid.plans import assessment_queries, grid_queries, model_queries, pixel_queries, result_queries, rule_queries  # noqa: F401 - importing registers
from loamgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
