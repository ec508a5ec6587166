"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from graphloom.plans import content, deeper, exchange, further, graph, knowledge, matching, publish, reading, reasons, temporal, texts

AREAS = (graph, temporal, knowledge, content, exchange, further, matching, publish, deeper, texts, reading, reasons)


def queries() -> dict:
    return {name: f for area in AREAS for name, f in area.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.S.items()}
