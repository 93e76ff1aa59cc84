"""A retention pass over the stored tables, in an order that a crash can't hurt.

What goes is worked out from one state and written down first: months that go whole, rows that get a tombstone, and
the parents whose children go with them. Then months are dropped, rows and children deleted, and entries of the feed
that lost their trace taken out. Each step repeats without harm, so the next pass ends what one has begun.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import retention, versions
from spanloom.schemas import SORT_TIME, TABLES
from spanloom.streaming.ingest import FAILED, Store, current_feed

PARENTS = "project_id string, trace_id string, expired_at timestamp"


def run_pass(store: Store, projects: DataFrame, now: datetime, default_days: int) -> dict[str, int]:
    """Carries out ``retention.plan`` for ``projects`` (project_id, retention_days). What it did, by name."""
    batch = f"_staged/{uuid.uuid4().hex}"
    try:
        return _run(store, batch, projects, now, default_days)
    finally:
        store.forget(batch)


def _run(store: Store, batch: str, projects: DataFrame, now: datetime, default_days: int) -> dict[str, int]:
    tables = {k: store.read(k) for k in TABLES}
    plan = retention.plan(*tables.values(), projects, now, default_days)
    done: dict[str, int] = {}
    drops = {k: sorted(r.month for r in plan[f"{k[:-1]}_months"].collect()) for k in TABLES}  # months of the store
    deleted = {}
    for k in TABLES:
        rest = plan[k].where(~F.date_format(SORT_TIME[k], "yyyy-MM").isin(drops[k])) if drops[k] else plan[k]
        deleted[k] = store.staged(rest, batch)
    parents = store.staged(plan["expired_parents"].select("project_id", "trace_id", F.lit(now).cast("timestamp").alias("expired_at")).distinct(), batch)
    known = store.read("retention_parents", PARENTS)
    parents.join(known, ["project_id", "trace_id"], "left_anti").write.mode("append").parquet(store.at("retention_parents"))
    for k in TABLES:
        done[f"{k}_months"] = sum(store.drop_month(k, m) for m in drops[k])
    for k in TABLES:
        done[k] = deleted[k].count()
        if done[k]:
            store.append(k, deleted[k])
    for k in ("observations", "scores"):  # children that outlived their trace, however new
        left = store.staged(retention.deletion_rows(retention.orphans(store.read(k), k, expired_parents(store), store.read("traces")), now), batch)
        done[f"orphan_{k}"] = left.count()
        if done[f"orphan_{k}"]:
            store.append(k, left)
    orphans = store.staged(retention.feed_orphans(current_feed(store), store.read("traces")).select("project_id", "trace_id"), batch)
    done["feed"] = orphans.count()
    if done["feed"]:
        store.prune("trace_feed", orphans)
    return done


def expired_parents(store: Store) -> DataFrame:
    """(project_id, trace_id): traces that retention took, for children that come after them."""
    return store.read("retention_parents", PARENTS).select("project_id", "trace_id").distinct()


def purged_failures(store: Store, now: datetime) -> DataFrame:
    """Failed events that are still kept."""
    return retention.purge(store.read("ingest_failures", FAILED), "created_at", now)


def live(store: Store, kind: str) -> DataFrame:
    return versions.latest(store.read(kind), kind)
