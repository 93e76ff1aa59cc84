"""Small keyed states: receipts, claims, cursors, snapshots and runs. Each function takes the state and what
happened and gives the rows to append or the new state; one writer owns each table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Minutes after which a claimed delivery or a lease counts as abandoned.
CLAIM_MINUTES, LEASE_MINUTES = 10, 5
#: Traces of an export page, of a run, and feed entries that a run looks at.
EXPORT_PAGE, EXPORT_RUN, EXPORT_SCAN = 100, 10_000, 100_000


def _minutes_before(now: datetime, minutes: int) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - minutes * 60_000_000)


def receipts(known: DataFrame, sent: DataFrame) -> DataFrame:
    """``sent`` (project_id, receipt_id, fingerprint) with ``outcome``: new, replay (same content) or conflict
    (the id was used for something else). Of equal ids within ``sent`` the first by ``ordinal`` is new."""
    key = ["project_id", "receipt_id"]
    order = W.partitionBy(*key).orderBy("ordinal")
    first = sent.withColumns({"_n": F.row_number().over(order), "_first": F.first("fingerprint").over(order)})
    joined = first.join(known.select(*key, F.col("fingerprint").alias("_known")), key, "left")
    told = F.coalesce("_known", F.when(F.col("_n") > 1, F.col("_first")))
    return joined.withColumn("outcome", F.when(told.isNull(), "new").when(told == F.col("fingerprint"), "replay").otherwise("conflict")).drop("_n", "_first", "_known")


def claims(deliveries: DataFrame, wanted: DataFrame, now: datetime) -> DataFrame:
    """``wanted`` (project_id, webhook_id, trace_id, version) with ``claim``: taken (never tried, failed before
    or abandoned), busy (another runner has it), done, or covered (a later version was delivered)."""
    key = ["project_id", "webhook_id", "trace_id"]
    newest = deliveries.groupBy(*key).agg(F.max_by(F.struct("version", "state", "claimed_at"), F.struct("version", "claimed_at")).alias("d"))
    joined = wanted.join(newest, key, "left")
    same, stale = F.col("d.version") == F.col("version"), F.col("d.claimed_at") < _minutes_before(now, CLAIM_MINUTES)
    claim = (
        F.when(F.col("d").isNull(), "taken").when((F.col("d.version") > F.col("version")) & (F.col("d.state") == "delivered"), "covered").when(same & (F.col("d.state") == "delivered"), "done")
        .when(same & (F.col("d.state") == "pending") & ~stale, "busy").otherwise("taken")
    )
    return joined.withColumn("claim", claim).drop("d")


def leased(runs: DataFrame, now: datetime) -> DataFrame:
    """Runs whose lease still holds; the others may be taken over."""
    return runs.where(F.col("leased_at") >= _minutes_before(now, LEASE_MINUTES))


def move_cursor(current: dict, seen: dict, moved_to: dict) -> tuple[dict, bool]:
    """The cursor after a run: it moves only if it still is where the run found it."""
    return (moved_to, True) if current == seen else (current, False)


def stage_snapshots(staged: DataFrame, pulled: DataFrame, now: datetime) -> DataFrame:
    """``pulled`` (project_id, trace_id, content_hash) with ``version`` and ``changed``: equal content keeps its
    version, other content gets one strictly later than the last."""
    key = ["project_id", "trace_id"]
    joined = pulled.join(staged.select(*key, F.col("content_hash").alias("_hash"), F.col("version").alias("_version")), key, "left")
    same = F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
    later = F.greatest(F.lit(now).cast("timestamp"), F.timestamp_micros(F.unix_micros("_version") + 1000))
    return joined.withColumns({"version": F.when(same, F.col("_version")).otherwise(later), "changed": ~same}).drop("_hash", "_version")


def settle_pending(snapshots: DataFrame, runs: DataFrame, cutoffs: DataFrame, now: datetime) -> DataFrame:
    """What to do with pending snapshots: discard (past the project's cutoff), wait (their run is alive) or
    publish (their run was abandoned)."""
    alive = leased(runs, now).select("run_id").distinct().withColumn("_alive", F.lit(True))
    joined = snapshots.where("status = 'pending'").join(cutoffs, "project_id", "left").join(alive, "run_id", "left")
    action = F.when(F.col("timestamp") < F.col("cutoff"), "discard").when(F.col("_alive"), "wait").otherwise("publish")
    return joined.withColumn("action", action).drop("cutoff", "_alive")


def after_failure(objects: DataFrame, published: DataFrame, pending: DataFrame) -> DataFrame:
    """``objects`` (project_id, object_key) of failed batches with ``action``: apply (their activity was
    published), retry (still pending) or quarantine."""
    key = ["project_id", "object_key"]
    p = published.select(*key).distinct().withColumn("_published", F.lit(True))
    w = pending.select(*key).distinct().withColumn("_pending", F.lit(True))
    joined = objects.join(p, key, "left").join(w, key, "left")
    return joined.withColumn("action", F.when(F.col("_published"), "apply").when(F.col("_pending"), "retry").otherwise("quarantine")).drop("_published", "_pending")


def expiry_vetoes(candidates: DataFrame) -> DataFrame:
    """Candidates for raw expiry with ``reason``, the first that speaks against it; null if none does. The
    facts are columns: a missing one speaks against it."""
    fact = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~fact("key_is_ours"), "unknown_key").when(~fact("is_due"), "not_due").when(fact("is_pending"), "pending").when(fact("is_failed"), "failed").when(~fact("refs_complete"), "references_truncated")
        .when(fact("has_live_trace"), "trace_retained").when(fact("has_intent"), "already_planned")
    )
    return candidates.withColumn("reason", reason)


def new_intents(known: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned intents whose object has none yet."""
    return planned.dropDuplicates(["project_id", "object_key"]).join(known.select("project_id", "object_key"), ["project_id", "object_key"], "left_anti")


def replace_overrides(stored: DataFrame, project_id: str, rules: DataFrame) -> DataFrame:
    """The override table with one project's rules replaced; their position is the list's order."""
    fresh = rules.withColumn("project_id", F.lit(project_id)).withColumn("position", F.row_number().over(W.orderBy("ordinal")) - 1)  # a handful of rules
    return stored.where(F.col("project_id") != project_id).unionByName(fresh.select(*stored.columns))
