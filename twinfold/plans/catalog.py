"""All registered queries."""

from twinfold.plans import queries_blocking, queries_match, queries_profile, queries_text  # noqa: F401
from twinfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
