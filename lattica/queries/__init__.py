"""Queries of the graph-retrieval operators, and their SQL."""

from lattica.queries import columns, contexts, core, graphs, registry, texts, vectors  # noqa: F401

QUERIES = core.QUERIES | registry.QUERIES
ORACLES = core.ORACLES | registry.ORACLES
