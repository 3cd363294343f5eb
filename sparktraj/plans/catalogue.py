"""All queries of the core and the SQL they are compared with, family by family."""
from __future__ import annotations

from . import clouds, exchange, graphs, sequences, shapes

FAMILIES: list = [graphs, clouds, sequences, shapes, exchange]


def queries() -> dict:
    return {k: v for m in FAMILIES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in FAMILIES for k, v in m.SQL.items()}
