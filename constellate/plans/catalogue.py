"""All registered queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from constellate.plans import graph_queries, harvest_queries, label_queries, problems, text_queries, view_queries

FLAGSHIP = "cosine_edges"
_MODULES = [problems, graph_queries, text_queries, label_queries, view_queries, harvest_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
