"""All queries: importing the modules fills the registry."""

from __future__ import annotations

from semifold.plans import queries_approximate, queries_data, queries_fields, queries_files, queries_gaussian, queries_graphs, queries_models, queries_search, queries_sources, registry

MODULES = (registry, queries_approximate, queries_data, queries_fields, queries_files, queries_gaussian, queries_graphs, queries_models, queries_search, queries_sources)
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
