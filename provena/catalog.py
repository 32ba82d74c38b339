"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from provena.plans import corpus_queries, feature_queries, other_queries, service_queries, similarity_queries

_ALL = [corpus_queries.r, similarity_queries.r, feature_queries.r, other_queries.r, service_queries.r]
QUERIES: dict = {k: v for x in _ALL for k, v in x.queries.items()}
ORACLES: dict[str, str] = {k: v for x in _ALL for k, v in x.oracles.items()}
FLAGSHIP = "audit_rollup"
