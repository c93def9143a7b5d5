"""Registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from . import blocks, chunks, enrichment, evaluation, retrieval, slides

MODULES = (retrieval, blocks, slides, chunks, enrichment, evaluation)
FLAGSHIP = "rrf_hybrid"
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: f for m in MODULES for k, f in m.ORACLE_SQL.items()}
