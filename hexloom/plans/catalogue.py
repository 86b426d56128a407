"""The query catalogue of the geospatial operators, and the same queries as DuckDB SQL."""

from __future__ import annotations

from hexloom.plans import graph, places, placing, records, surface, terrain, water

_PARTS = (places, terrain, records, water, graph, surface, placing)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
