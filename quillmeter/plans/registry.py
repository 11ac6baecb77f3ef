"""Registered core queries and their DuckDB equivalents."""

from __future__ import annotations

from . import read_queries, store_queries, write_queries


def queries():
    return read_queries.QUERIES | write_queries.QUERIES | store_queries.QUERIES


def oracle_sql():
    return read_queries.ORACLES | write_queries.ORACLES | store_queries.ORACLES
