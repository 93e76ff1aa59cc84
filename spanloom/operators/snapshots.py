"""Imported traces on their way to publication: what they hold, who may stage, publish or discard them.

The state has a row per (project_id, source, trace_id). A run is known by (project_id, source, run_token) and may write
while its lease holds; each function gives the rows to write, which replace those of the same key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import canonical_json

KEY, RUN = ["project_id", "source", "trace_id"], ["project_id", "source"]
STATE = (
    "project_id string, source string, trace_id string, content_hash string, tree_hash string, activity_id string, source_activity_at timestamp, snapshot string, "
    "run_token string, pending boolean, publish_required boolean, staged_at timestamp"
)
_WORDS = 8


def content_hashes(traces: DataFrame, parts: DataFrame) -> DataFrame:
    """(project_id, trace_id, content_hash, tree_hash) of ``traces`` (project_id, trace_id, body) with their ``parts``
    (project_id, trace_id, kind: observation or score, body); the tree leaves the scores out. Bodies are JSON, and the
    order of their keys and of the parts doesn't matter; repeated parts count. A body that isn't JSON counts as text.

    Parts are added up as eight words of their SHA-256, so that a trace of any number of parts is one row of sums in
    every task and is never gathered."""
    sha = lambda: F.sha2(F.coalesce(canonical_json("body"), F.concat(F.lit("text:"), F.coalesce("body", F.lit("")))), 256)
    words = [F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long") for i in range(_WORDS)]
    each = parts.select("project_id", "trace_id", "kind", sha().alias("sha"))
    of = lambda kind: [F.count_if(F.col("kind") == kind), *[F.sum(F.when(F.col("kind") == kind, w)) for w in words]]
    told = lambda kind: F.concat_ws(",", *[F.coalesce(c, F.lit(0)).cast("string") for c in of(kind)])
    sums = each.groupBy("project_id", "trace_id").agg(told("observation").alias("o"), told("score").alias("s"))
    none = F.lit(",".join("0" * (_WORDS + 1)))
    joined = traces.select("project_id", "trace_id", sha().alias("sha")).join(sums, ["project_id", "trace_id"], "left")
    tree = F.concat_ws(";", "sha", F.coalesce("o", none))
    return joined.select("project_id", "trace_id", F.sha2(F.concat_ws(";", tree, F.coalesce("s", none)), 256).alias("content_hash"), F.sha2(tree, 256).alias("tree_hash"))


def _at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def active(runs: DataFrame, now: datetime | Column) -> DataFrame:
    """(project_id, source, run_token) of runs (status, run_token, lease_expires_at) that may write."""
    return runs.where((F.col("status") == "running") & (F.col("lease_expires_at") > _at(now))).select(*RUN, "run_token")


def stage(state: DataFrame, pulled: DataFrame, runs: DataFrame, now: datetime | Column) -> DataFrame:
    """Rows for ``pulled`` (KEY, run_token, ordinal, content_hash, tree_hash, activity_id, source_activity_at,
    snapshot), of which the last of each key counts; nothing for a run that may not write. Equal content keeps what was
    staged or published. Other content is pending, at a time strictly after the last, and has to be published only if the
    tree changed."""
    order = W.partitionBy(*KEY).orderBy(F.desc("ordinal"))
    mine = pulled.join(active(runs, now), [*RUN, "run_token"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    kept = ("content_hash", "tree_hash", "activity_id", "source_activity_at", "snapshot", "run_token", "pending", "publish_required")
    joined = mine.join(state.select(*KEY, F.struct(*kept).alias("old")), KEY, "left")
    old = lambda c: F.col("old")[c]
    known, same = F.col("old").isNotNull(), F.coalesce(old("content_hash") == F.col("content_hash"), F.lit(False))
    idle = same & ~old("pending")
    at = F.date_trunc("millisecond", "source_activity_at")
    later = F.greatest(at, F.timestamp_micros(F.unix_micros(old("source_activity_at")) + 1000))
    return joined.select(
        *KEY, "content_hash", "tree_hash", F.when(same, old("activity_id")).otherwise(F.col("activity_id")).alias("activity_id"), F.when(same, old("source_activity_at")).when(known, later).otherwise(at).alias("source_activity_at"),
        F.when(same, old("snapshot")).otherwise(F.col("snapshot")).alias("snapshot"), F.when(idle, old("run_token")).otherwise(F.col("run_token")).alias("run_token"), (~idle).alias("pending"),
        F.when(same, old("publish_required")).when(known, ~old("tree_hash").eqNullSafe(F.col("tree_hash"))).otherwise(F.lit(True)).alias("publish_required"), _at(now).alias("staged_at"),
    )


def claim_pending(state: DataFrame, runs: DataFrame, now: datetime | Column) -> DataFrame:
    """All pending rows of projects and sources with a run that may write, now under that run's token."""
    held = active(runs, now).withColumnRenamed("run_token", "_token")
    return state.where("pending").join(held, RUN).withColumns({"run_token": F.col("_token"), "staged_at": _at(now)}).select(*state.columns)


def discard(state: DataFrame, named: DataFrame, runs: DataFrame, now: datetime | Column) -> tuple[DataFrame, DataFrame]:
    """(rows to write, stale names) for ``named`` (KEY, activity_id, source_activity_at, run_token): a snapshot goes only
    if it still is pending as named and its run may write."""
    same = [*KEY, "activity_id", "source_activity_at", "run_token"]
    mine = state.where("pending").join(active(runs, now), [*RUN, "run_token"], "left_semi").join(named.select(*same).distinct(), same, "left_semi")
    gone = mine.withColumns({"pending": F.lit(False), "snapshot": F.lit(None).cast("string"), "run_token": F.lit(None).cast("string"), "publish_required": F.lit(False)})
    return gone.select(*state.columns), named.join(mine.select(*same), same, "left_anti")


def recovery_candidates(state: DataFrame, runs: DataFrame, now: datetime | Column) -> DataFrame:
    """(project_id, source) with pending snapshots whose run ended or lost its lease. A caller pages by this key."""
    lapsed = runs.where(~((F.col("status") == "running") & F.coalesce(F.col("lease_expires_at") > _at(now), F.lit(False))))
    return state.where("pending").select(*RUN).distinct().join(lapsed.select(*RUN), RUN, "left_semi")
