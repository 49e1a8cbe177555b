"""The registered queries and their SQL."""

from __future__ import annotations

from . import feature_queries, model_queries, panel_queries, research_queries, selection_queries, study_queries, walk_queries

FLAGSHIP = "xs_pct_rank"
MODULES = (feature_queries, panel_queries, research_queries, selection_queries, model_queries, walk_queries, study_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
