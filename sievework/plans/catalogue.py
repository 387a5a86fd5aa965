"""Every registered query of the library and its oracle."""

from __future__ import annotations

from sievework.plans import corpus, graphs, pages, retrieval, stores, telemetry, texts

_PARTS = (retrieval, texts, graphs, corpus, stores, pages, telemetry)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
