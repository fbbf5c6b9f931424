"""Queries of the library and the SQL that gives the same rows, by name."""

from __future__ import annotations

from . import analytics, chunks, extraction, graphs, hierarchy, items, layout, records, structure, texts

MODULES = (texts, extraction, structure, items, analytics, graphs, hierarchy, chunks, layout, records)
QUERIES = {name: run for m in MODULES for name, (run, _) in m.ALL.items()}
ORACLES = {name: sql for m in MODULES for name, (_, sql) in m.ALL.items() if sql}
