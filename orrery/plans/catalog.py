"""All core queries and their SQL."""

from __future__ import annotations

from orrery.plans import context, graphs, integrity, lookups, quality, relations, scans, search, streams

MODULES = [integrity, scans, relations, search, graphs, context, streams, quality, lookups]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
