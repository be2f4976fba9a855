"""Importing this module registers every query."""

from marketframe.plans import parts  # noqa: F401
from marketframe.plans import checks, crosssection, features, ledger, panels, performance, pointintime, weights  # noqa: F401
from marketframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
