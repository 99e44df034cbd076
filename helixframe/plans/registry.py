"""All queries of the core, with their SQL."""

from __future__ import annotations

from . import general_queries, network_queries, omics_queries, reader_queries

_MODULES = (general_queries, network_queries, omics_queries, reader_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
