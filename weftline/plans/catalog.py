"""All queries over the driver tables and their SQL oracles."""

from __future__ import annotations

from weftline.plans import listing, logs, maths, streams  # noqa: F401  (they register their queries)
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
