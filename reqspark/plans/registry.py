"""Every query of the library with its SQL, by name."""

from __future__ import annotations

from . import case_queries, context_queries, raft_queries, report_queries, source_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (context_queries, case_queries, raft_queries, report_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
