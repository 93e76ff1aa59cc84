"""What an evaluator reads: first everything that is stored, then the feed, and single traces at an exact version.

A reader starts with a bootstrap cursor, which fixes two things: up to which time of activity stored traces are
listed, and where the feed stood. The bootstrap lists stored versions in order of (version, trace_id), but only of
traces whose feed entry isn't later than that place; the feed is then read from that place on. A trace that is
published while the bootstrap runs comes by the feed, exactly once. ``through`` reaches a quiet period beyond the
start, so that traces which were still active then are waited for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.settlement import FEED_KEY, feed_status, versioned


@dataclass(frozen=True)
class Cursor:
    """``phase`` is bootstrap or live. ``feed`` is the last (published_at, trace_id) that counts as read."""

    phase: str
    feed: tuple[datetime, str] | None = None
    through: datetime | None = None
    after: tuple[datetime, str] | None = None


def start(feed: DataFrame, settled_before: datetime, quiet: timedelta) -> Cursor:
    """The first cursor of a project's reader. ``feed`` has one row a trace."""
    last = feed.agg(F.max(F.struct("published_at", "trace_id")).alias("last")).first().last
    return Cursor("bootstrap", (last.published_at, last.trace_id) if last else None, settled_before + quiet)


def _later(a: str, b: str, cursor: tuple) -> object:
    return (F.col(a) > F.lit(cursor[0])) | ((F.col(a) == F.lit(cursor[0])) & (F.col(b) > cursor[1]))


def candidates(traces: DataFrame, observations: DataFrame, feed: DataFrame, cursor: Cursor, settled_before: datetime) -> DataFrame:
    """(project_id, trace_id, version) that the bootstrap lists: settled, and not to come by the feed."""
    held = versioned(traces, observations, min(settled_before, cursor.through)).groupBy("project_id", F.col("id").alias("trace_id")).agg(F.max("trace_version").alias("version"))
    if cursor.feed is None:
        return held.join(feed.select(*FEED_KEY).distinct(), FEED_KEY, "left_anti")
    return held.join(feed.where(_later("published_at", "trace_id", cursor.feed)).select(*FEED_KEY).distinct(), FEED_KEY, "left_anti")


def _prefix(rows: list, limit: int) -> tuple[list, object, bool]:
    """(rows to send, the last that is consumed, was one blocked) of one page."""
    sent, last = [], None
    for r in rows[:limit]:
        if r.status == "blocked":
            return sent, last, True
        sent += [r] if r.status == "emit" else []
        last = r
    return sent, last, False


def page(cursor: Cursor, traces: DataFrame, observations: DataFrame, feed: DataFrame, pending: DataFrame, settled_before: datetime, limit: int) -> tuple[list, Cursor, bool]:
    """(rows (trace_id, version), the next cursor, is there more) of one project. A page ends before the first trace
    with pending work, or whose stored version the feed doesn't have yet; what retention took back is stepped over."""
    if cursor.phase == "bootstrap":
        found = candidates(traces, observations, feed, cursor, settled_before)
        if cursor.after:
            found = found.where(_later("version", "trace_id", cursor.after))
        found = found.orderBy("version", "trace_id").limit(limit + 1)
        known = feed.select(*FEED_KEY, F.col("version").alias("published"))
        waiting = pending.select(*FEED_KEY).distinct().withColumn("waiting", F.lit(True))
        told = found.join(known, FEED_KEY, "left").join(waiting, FEED_KEY, "left")
        status = F.when(F.col("waiting") | (F.col("version") > F.col("published")), "blocked").when(F.col("version") < F.col("published"), "step_over").otherwise("emit")
        rows = told.withColumn("status", status).orderBy("version", "trace_id").collect()
        sent, last, blocked = _prefix(rows, limit)
        more = len(rows) > limit
        after = (last.version, last.trace_id) if last else cursor.after
        if more or blocked:
            return sent, replace(cursor, after=after), last is not None if blocked else more
        if settled_before < cursor.through:  # what settles later still belongs to the bootstrap
            return sent, replace(cursor, after=after), False
        return sent, Cursor("live", cursor.feed), False
    entries = feed.where(_later("published_at", "trace_id", cursor.feed)) if cursor.feed else feed
    entries = entries.orderBy("published_at", "trace_id").limit(limit + 1)
    ids = entries.select(*FEED_KEY)
    current = versioned(traces, observations, ids=ids).groupBy("project_id", F.col("id").alias("trace_id")).agg(F.max("trace_version").alias("version"))
    rows = feed_status(entries, current, pending, settled_before).orderBy("published_at", "trace_id").collect()
    sent, last, blocked = _prefix(rows, limit)
    return sent, Cursor("live", (last.published_at, last.trace_id) if last else cursor.feed), not blocked and len(rows) > limit


def exact(read, project_id: str, trace_id: str, version: datetime, settled_before: datetime) -> dict:
    """A trace at exactly one version: {"status": ok, not_found or conflict, "trace", "observations"}.

    ``read(project_id, trace_id)`` gives (traces, observations, feed, pending) as they stand, each call anew; the
    frames of one call belong to one listing of files. The version is looked up before and after the observations
    are read, pending work and the feed's entry with it: if any of them moved, what was read is no one version."""

    def state() -> tuple:
        traces, observations, feed, pending = read(project_id, trace_id)
        if pending.head(1):
            return "pending", None, None, observations
        entry = feed.where(F.col("trace_id") == trace_id).select("published_at", "version").first()
        found = versioned(traces, observations).where(F.col("id") == trace_id).orderBy(F.desc("timestamp")).first()
        return (tuple(entry) if entry else None), found, found.trace_version if found else None, observations

    published, trace, held, observations = state()
    if published == "pending":
        return {"status": "conflict"}
    if trace is None:
        return {"status": "not_found"}
    if held != version or held > settled_before or (published and published[1] != held):
        return {"status": "conflict"}
    from spanloom.operators.versions import latest

    children = latest(observations, "observations").orderBy("start_time", "id").collect()
    again = state()
    if (again[0], again[2]) != (published, held):
        return {"status": "conflict"}
    return {"status": "ok", "trace": trace, "observations": children}
