"""The queries of this subpackage."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}
for _name in ("q_neighbours", "q_leakage", "q_near", "q_syntax", "q_splitting", "q_provenance", "q_packing", "q_prose"):
    _m = importlib.import_module(f"orrery.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
