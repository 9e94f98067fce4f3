"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from clausewright.plans import contracts, measures, search  # noqa: F401
from clausewright.plans.registry import ORACLES, QUERIES  # noqa: F401
