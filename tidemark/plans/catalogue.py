"""All registered queries by name and the SQL that checks them."""

from __future__ import annotations

from . import cells, feeds, funnel, ingest, joins, ledgers, postings, runs, scoring, served, streams, texts, versions

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (funnel, cells, versions, joins, ledgers, texts, scoring, ingest, streams, postings, served, runs, feeds):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
