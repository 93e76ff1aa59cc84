"""Retention: what is past its project's days goes, but children of a live trace stay with it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.versions import latest, tombstones
from spanloom.schemas import SORT_TIME

#: Hours of grace before a month is dropped; days that bookkeeping is kept.
GRACE_HOURS, BOOKKEEPING_DAYS = 24, 30
TRACE = ["project_id", "trace_id"]


def cutoffs(projects: DataFrame, now: datetime, default_days: int) -> DataFrame:
    """(project_id, days, cutoff) of (project_id, retention_days); null days mean the default."""
    days = F.coalesce("retention_days", F.lit(default_days))
    return projects.select("project_id", days.alias("days"), F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - days.cast("long") * 86_400_000_000).alias("cutoff"))


def floor_days(limits: DataFrame) -> DataFrame:
    """The longest retention of all projects: months before it can be dropped whole."""
    return limits.agg(F.max("days").alias("days"), F.min("cutoff").alias("cutoff"))


def expired_rows(df: DataFrame, kind: str, limits: DataFrame) -> DataFrame:
    """Live rows past their project's cutoff."""
    return latest(df, kind).join(limits.select("project_id", "cutoff"), "project_id").where(F.col(SORT_TIME[kind]) < F.col("cutoff")).drop("cutoff")


def retained_parents(traces: DataFrame, limits: DataFrame) -> DataFrame:
    """(project_id, trace_id) of live traces that aren't past the cutoff."""
    live = latest(traces, "traces").join(limits.select("project_id", "cutoff"), "project_id")
    return live.where(F.col("timestamp") >= F.col("cutoff")).select("project_id", F.col("id").alias("trace_id")).distinct()


def child_deletes(children: DataFrame, kind: str, traces: DataFrame, limits: DataFrame) -> DataFrame:
    """Children past the cutoff, other than those of a retained trace."""
    return expired_rows(children, kind, limits).join(retained_parents(traces, limits), TRACE, "left_anti")


def expired_parents(traces: DataFrame, limits: DataFrame) -> DataFrame:
    """(project_id, trace_id) to write down before any deletion, so that children can follow later."""
    return expired_rows(traces, "traces", limits).select("project_id", F.col("id").alias("trace_id")).distinct()


def orphans(children: DataFrame, kind: str, recorded: DataFrame, traces: DataFrame) -> DataFrame:
    """Live children, however new, of recorded traces of which nothing is live any more."""
    alive = latest(traces, "traces").select("project_id", F.col("id").alias("trace_id"))
    gone = recorded.join(alive, TRACE, "left_anti")
    return latest(children, kind).join(gone, TRACE, "left_semi")


def droppable_months(df: DataFrame, kind: str, cutoff, parents: DataFrame | None = None) -> DataFrame:
    """(month): partitions whose every row is older than the cutoff and its grace; with ``parents``, none of
    them may belong to a retained trace."""
    time = SORT_TIME[kind]
    month = F.date_format(time, "yyyy-MM")
    limit = F.timestamp_micros(F.unix_micros(cutoff) - GRACE_HOURS * 3_600_000_000)
    old = df.groupBy(month.alias("month")).agg(F.max(time).alias("last")).where(F.col("last") < limit).select("month")
    if parents is not None:
        held = df.withColumn("month", month).join(parents, TRACE, "left_semi").select("month").distinct()
        old = old.join(held, "month", "left_anti")
    return old


def deletion_rows(df: DataFrame, now: datetime) -> DataFrame:
    return tombstones(df, now)


def candidate_counts(tables: dict[str, DataFrame], limits: DataFrame) -> DataFrame:
    """A row per project, also where nothing is due: counts of rows past the cutoff, per table."""
    out = limits.select("project_id")
    for kind, df in tables.items():
        counts = expired_rows(df, kind, limits).groupBy("project_id").agg(F.count("*").alias(kind))
        out = out.join(counts, "project_id", "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    return out


def feed_orphans(feed: DataFrame, traces: DataFrame) -> DataFrame:
    """Feed entries whose trace isn't live."""
    alive = latest(traces, "traces").select("project_id", F.col("id").alias("trace_id"))
    return feed.join(alive, TRACE, "left_anti")


def purge(df: DataFrame, time: str, now: datetime, days: int = BOOKKEEPING_DAYS) -> DataFrame:
    """Bookkeeping rows that stay."""
    return df.where(F.col(time) >= F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - days * 86_400_000_000))


def plan(traces: DataFrame, observations: DataFrame, scores: DataFrame, projects: DataFrame, now: datetime, default_days: int) -> dict[str, DataFrame]:
    """Everything that a retention pass writes, in the order it must be written: parents are recorded
    before rows go, and months drop only under the longest retention."""
    limits = cutoffs(projects, now, default_days)
    parents, floor = expired_parents(traces, limits), floor_days(limits).first()
    kept = retained_parents(traces, limits)
    at = F.lit(floor.cutoff)
    return {
        "expired_parents": parents,
        "trace_months": droppable_months(traces, "traces", at),
        "observation_months": droppable_months(observations, "observations", at, kept),
        "score_months": droppable_months(scores, "scores", at, kept),
        "traces": deletion_rows(expired_rows(traces, "traces", limits), now),
        "observations": deletion_rows(child_deletes(observations, "observations", traces, limits), now),
        "scores": deletion_rows(child_deletes(scores, "scores", traces, limits), now),
    }
