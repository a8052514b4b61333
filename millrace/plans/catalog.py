"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from millrace.plans import report_queries, rule_queries, search_queries

QUERIES = search_queries.QUERIES | rule_queries.QUERIES | report_queries.QUERIES
ORACLE_SQL = search_queries.SQL | rule_queries.SQL | report_queries.SQL
