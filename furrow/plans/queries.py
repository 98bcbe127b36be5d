"""All queries of the library, and their SQL."""

from __future__ import annotations

from furrow.plans import catalog, file_catalog, more_catalog, season_catalog
from furrow.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "file_catalog", "more_catalog", "season_catalog"]
