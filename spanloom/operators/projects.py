"""The registry of projects: (id, organization_id, name, created_at, retention_days, quiet_seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: seconds without activity after which a trace counts as settled, where a project says nothing else.
QUIET_SECONDS = 300


def by_ids(projects: DataFrame, ids: DataFrame) -> DataFrame:
    """The projects asked for; ``ids`` has id."""
    return projects.join(ids.select("id").distinct(), "id", "left_semi")


def of_organization(projects: DataFrame, organization_id: str) -> DataFrame:
    return projects.where(F.col("organization_id") == organization_id)


def oldest(projects: DataFrame, limit: int) -> DataFrame:
    """The oldest projects, one more than asked for: who gets it knows that there are more."""
    return projects.orderBy("created_at", "id").limit(limit + 1)


def settled_before(now: Column) -> Column:
    """Up to which activity a project's traces are settled, by its own quiet period."""
    quiet = F.coalesce(F.col("quiet_seconds"), F.lit(QUIET_SECONDS)).cast("long")
    return F.timestamp_micros(F.unix_micros(now) - quiet * 1_000_000)
