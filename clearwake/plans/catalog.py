"""Importing this module registers every query."""

from clearwake.plans import index_plans, ops_plans, policy_plans, source_plans, stream_plans, text_plans, web_plans  # noqa: F401
from clearwake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
