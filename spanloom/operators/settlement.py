"""Settlement and feeds: a trace's version is the newest change of it or its observations, and it counts
as settled once that is older than the quiet period. Scores never reopen a trace."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.versions import latest

FEED_KEY = ["project_id", "trace_id"]


def activity(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """(project_id, trace_id, version) over the live rows of both tables. Takes all versions."""
    own = latest(traces, "traces").select("project_id", F.col("id").alias("trace_id"), "event_ts")
    theirs = latest(observations, "observations").select("project_id", "trace_id", "event_ts")
    return own.unionByName(theirs).groupBy(*FEED_KEY).agg(F.max("event_ts").alias("version"))


def versioned(traces: DataFrame, observations: DataFrame, settled_before: datetime | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Live traces with their ``trace_version``; of ``ids`` (project_id, trace_id) only, if given."""
    if ids is not None:
        traces = traces.join(ids.select("project_id", F.col("trace_id").alias("id")), ["project_id", "id"], "left_semi")
        observations = observations.join(ids, FEED_KEY, "left_semi")
    clock = activity(traces, observations)
    if settled_before is not None:
        clock = clock.where(F.col("version") <= F.lit(settled_before))
    clock = clock.select("project_id", F.col("trace_id").alias("id"), F.col("version").alias("trace_version"))
    return latest(traces, "traces").join(clock, ["project_id", "id"])


def publish(activities: DataFrame) -> DataFrame:
    """The feed after ``activities`` (project_id, trace_id, activity_id, version, published_at): one row per
    trace, that of its last new activity. Replays of an activity change nothing."""
    first = W.partitionBy(*FEED_KEY, "activity_id").orderBy("published_at")
    fresh = activities.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    last = W.partitionBy(*FEED_KEY).orderBy(F.desc("published_at"), F.desc("activity_id"))
    return fresh.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def publication_clock(activities: DataFrame, last: Column) -> DataFrame:
    """Gives each project's activities strictly rising times: now, or a microsecond after the one before."""
    order = W.partitionBy("project_id").orderBy("activity_id", "trace_id")
    base = F.greatest(F.unix_micros("received_at"), F.unix_micros(last) + 1)
    n = F.row_number().over(order)
    return activities.withColumn("published_at", F.timestamp_micros(F.max(base - n).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + n))


def feed_status(feed: DataFrame, current: DataFrame, pending: DataFrame, settled_before: datetime) -> DataFrame:
    """``feed`` with ``status``: emit (settled, the feed's version is the current one), step_over (the trace
    is gone or the entry is older than the current version) or blocked (pending work, not settled yet, or the
    entry is newer than what is stored)."""
    now = current.select(*FEED_KEY, F.col("version").alias("current_version"))
    waiting = pending.select(*FEED_KEY).distinct().withColumn("_pending", F.lit(True))
    joined = feed.join(now, FEED_KEY, "left").join(waiting, FEED_KEY, "left")
    status = (
        F.when(F.col("_pending").isNotNull(), "blocked")
        .when(F.col("current_version").isNull() | (F.col("version") < F.col("current_version")), "step_over")
        .when(F.col("version") > F.col("current_version"), "blocked")
        .when(F.col("version") > F.lit(settled_before), "blocked")
        .otherwise("emit")
    )
    return joined.withColumn("status", status).drop("_pending")


def prefix(statuses: DataFrame) -> DataFrame:
    """The entries to emit before the first blocked one of each project, in feed order."""
    first = statuses.where("status = 'blocked'").groupBy("project_id").agg(F.min(F.struct("published_at", "trace_id")).alias("_stop"))
    joined = statuses.join(first, "project_id", "left")
    before = F.col("_stop").isNull() | (F.struct("published_at", "trace_id") < F.col("_stop"))
    return joined.where(before & (F.col("status") == "emit")).drop("_stop")


def score_feed(scores: DataFrame, trace_feed: DataFrame) -> DataFrame:
    """(project_id, trace_id, published_at): traces whose scores changed in batches that left the trace alone."""
    changed = scores.groupBy(*FEED_KEY).agg(F.max("event_ts").alias("published_at"))
    same = trace_feed.select(*FEED_KEY, "published_at")
    return changed.join(same, [*FEED_KEY, "published_at"], "left_anti")


def stale_scores(score_feed_: DataFrame, projects: DataFrame, trace_feed: DataFrame) -> DataFrame:
    """Score feed rows past their project's cutoff whose trace isn't in the trace feed."""
    old = score_feed_.join(projects.select("project_id", "cutoff"), "project_id").where("published_at < cutoff")
    return old.join(trace_feed.select(*FEED_KEY), FEED_KEY, "left_anti").drop("cutoff")


def drop_published(feed: DataFrame, handled: DataFrame) -> DataFrame:
    """The feed without the (project_id, trace_id, version) that were handled; a newer entry stays."""
    return feed.join(handled.select(*FEED_KEY, "version"), [*FEED_KEY, "version"], "left_anti")


def pending_union(raw: DataFrame, imports: DataFrame) -> DataFrame:
    """Traces with work under way: raw events not applied yet, or imports still to be published."""
    staged = imports.where("status = 'pending' and publish_required").select(*FEED_KEY)
    return raw.select(*FEED_KEY).union(staged).distinct()


def forward_only_cutoffs(recorded: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per project the later of the recorded and the proposed cutoff."""
    return recorded.select("project_id", "cutoff").unionByName(proposed.select("project_id", "cutoff")).groupBy("project_id").agg(F.max("cutoff").alias("cutoff"))


def seed_cutoffs(recorded: DataFrame, proposed: DataFrame) -> DataFrame:
    """Recorded cutoffs, and proposed ones for projects that have none."""
    return recorded.select("project_id", "cutoff").unionByName(proposed.select("project_id", "cutoff").join(recorded, "project_id", "left_anti"))


def next_batch(statuses: DataFrame, cursor: tuple | None, limit: int) -> tuple[list, tuple | None]:
    """The entries that one run exports, and where the next run begins: feed order from the cursor
    (published_at, trace_id) of one project, up to the first blocked entry, ``limit`` entries at most. Entries
    that are stepped over move the cursor too. The cursor is stored once the run's files are."""
    if cursor is not None:
        statuses = statuses.where(F.struct("published_at", "trace_id") > F.struct(F.lit(cursor[0]).cast("timestamp").alias("published_at"), F.lit(cursor[1]).alias("trace_id")))
    seen = statuses.orderBy("published_at", "trace_id").limit(limit).collect()
    stop = next((i for i, r in enumerate(seen) if r.status == "blocked"), len(seen))
    done = seen[:stop]
    return [r for r in done if r.status == "emit"], ((done[-1].published_at, done[-1].trace_id) if done else cursor)
