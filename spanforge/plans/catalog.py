"""All queries of the library and their oracles."""

from __future__ import annotations

from . import metric_queries, record_queries, segment_queries

_ALL = {**segment_queries.QUERIES, **metric_queries.QUERIES, **record_queries.QUERIES}


def queries():
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
