"""All queries of the core, with their SQL."""

from __future__ import annotations

from boardwright.plans import boards, core_problems, intake, listings, operations, retrieval, surface, upkeep

_MODULES = [core_problems, boards, listings, intake, retrieval, operations, upkeep, surface]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "score_board"
