"""All registered queries."""

from __future__ import annotations

from tabaudit.plans import chain_queries, print_queries, record_queries, report_queries, stage_queries, statistic_queries, stream_queries, tree_queries
from tabaudit.plans.base import Query

QUERIES: dict[str, Query] = {}
for _module in (record_queries, chain_queries, statistic_queries, report_queries, stage_queries, tree_queries, stream_queries, print_queries):
    QUERIES.update(_module.registry.entries)
