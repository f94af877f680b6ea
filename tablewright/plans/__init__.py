"""The registered queries; importing this package registers all of them."""

from tablewright.plans import closed_form_queries, cluster_queries, learner_queries, model_queries, table_queries  # noqa: F401
from tablewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
