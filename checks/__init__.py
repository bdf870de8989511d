"""Registered queries over the given tables, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations


def all_queries():
    """Every registered query and every SQL twin."""
    from checks import catalog, cubes, ingest, periods, spatial, zonal  # noqa: F401
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
