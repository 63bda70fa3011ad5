"""All queries of the health-record engine by name, and the SQL that states the same."""

from __future__ import annotations

from . import file_queries, job_queries, keyed_queries, quality_queries, report_queries, scalar_queries

MODULES = (report_queries, scalar_queries, keyed_queries, quality_queries, file_queries, job_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
