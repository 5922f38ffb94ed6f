"""Registered queries, each with its SQL."""

from ledgerline.plans import analysis, core, flow, reports, scalar, streams, trees
from ledgerline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "core", "reports", "scalar", "streams", "trees"]
