"""All registered queries."""

from __future__ import annotations

from dayglass.plans import (  # noqa: F401
    catalog_exact,
    catalog_models,
    catalog_profiles,
    catalog_sources,
    catalog_tables,
)
from dayglass.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
