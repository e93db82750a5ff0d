"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from treeline.plans import editing, history, ingest, lifecycle, provenance, reads, retrieval, training

_MODULES = (training, reads, retrieval, history, provenance, ingest, editing, lifecycle)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
