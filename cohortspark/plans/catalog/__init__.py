"""The registered queries: every operator on whole tables, with its SQL counterpart."""

from cohortspark.plans.catalog import (  # noqa: F401
    assignments,
    closed_forms,
    contracts,
    features,
    fitted,
    saturated,
    scans,
    scores,
    workflows,
)
from cohortspark.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
