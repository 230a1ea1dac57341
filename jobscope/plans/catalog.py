"""All registered queries."""

from __future__ import annotations

from jobscope.plans import q_files, q_finish, q_functions, q_graph, q_ledger, q_reads, q_sources, q_streams, q_usage  # noqa: F401
from jobscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
