"""Every query of the library by name, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from tidewell.plans import authoring, clones, entities, facts, functions, graphs, history, lifecycle, matching, platform, retrieval, rules, scalars, streams  # noqa: F401  (they register their queries)
from tidewell.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "hybrid_retrieve"
