"""Imports every query module, so that the registry is complete."""

from ionloom.plans import cohort_queries, evidence_queries, rule_queries, source_queries, spectral_queries, text_queries  # noqa: F401
from ionloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
