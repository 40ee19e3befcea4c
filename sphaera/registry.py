"""All registered queries of the library proper, with their SQL oracles."""

from __future__ import annotations

from sphaera.plans import exchange, extras, graph, landscape, manifold, orientation, run, stages

_PARTS = (orientation, manifold, landscape, graph, stages, extras, exchange, run)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
