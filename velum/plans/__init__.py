"""Registered queries. Importing this package fills ``QUERIES`` and ``ORACLES``."""

from velum.plans import activity, detection, governance, surfaces  # noqa: F401
from velum.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
