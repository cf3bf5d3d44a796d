"""All queries of the reference's operators with their oracle SQL."""

from __future__ import annotations

from . import benchmark_queries, exact_queries, file_queries, job_queries, metric_queries, structure_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (benchmark_queries, job_queries, text_queries, structure_queries, metric_queries, exact_queries, file_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
