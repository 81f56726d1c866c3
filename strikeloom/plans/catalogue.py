"""Every registered query of the reference's domain, by name, with its SQL."""

from strikeloom.plans import archive_queries, chain_queries, contest_queries, context_queries, evidence_queries, inference_queries, model_queries, pricing_queries, snapshot_queries, study_queries, view_queries, wheel_queries  # noqa: F401
from strikeloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
