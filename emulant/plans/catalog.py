"""All registered queries."""

from emulant.plans import queries_estimation, queries_evaluation, queries_panel  # noqa: F401
from emulant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
