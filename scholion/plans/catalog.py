"""All queries of the core, with their SQL."""

from __future__ import annotations

from scholion.plans import enrich_queries, nested_queries, reader_queries, record_queries, triage_queries

FLAGSHIP = "triage"


def queries() -> dict:
    return {**triage_queries.queries(), **record_queries.queries(), **reader_queries.queries(), **enrich_queries.queries(), **nested_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**triage_queries.oracle_sql(), **record_queries.oracle_sql(), **reader_queries.oracle_sql(), **enrich_queries.oracle_sql(), **nested_queries.oracle_sql()}
