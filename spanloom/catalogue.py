"""Every query of the catalogue by name, with its DuckDB twin."""

from __future__ import annotations

from spanloom.plans import exports, feeds, ingest, lists, services, upkeep

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (lists, feeds, upkeep, exports, ingest, services):
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
