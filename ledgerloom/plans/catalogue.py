"""All registered queries."""

from ledgerloom.plans import learn_queries, ledger_queries, matrix_queries, metric_queries, scoring_queries  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
