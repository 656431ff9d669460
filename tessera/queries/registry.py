"""Collects the query and SQL tables of every binding module."""

from __future__ import annotations

from tessera.queries import analysis, decisions, forecast, landed, requests, streams, tables, tables_sql

QUERY_MODULES = (requests, forecast, analysis, tables, landed, decisions, streams)
SQL_MODULES = (requests, forecast, analysis, tables_sql, landed, decisions, streams)


def all_queries() -> dict:
    return {name: fn for module in QUERY_MODULES for name, fn in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in SQL_MODULES for name, sql in module.ORACLES.items()}
