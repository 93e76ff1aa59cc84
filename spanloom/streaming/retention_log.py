"""Expiry of raw objects by a write-ahead log of intents.

An intent is prepared once for an object that nothing speaks against, and each step is committed before the next
begins: prepared, fenced (readers treat the object as gone), deleting (all facts were checked once more), done. A run
that dies goes on where the log stands, and every step can be repeated: a fenced object is checked again, a deleted
one stays deleted, markers and expired references are added only where they are missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import refs, state
from spanloom.streaming.ingest import REFS, Store
from spanloom.streaming.ledger import Ledger

INTENTS = "project_id string, intent_id string, object_key string, size bigint, trace_ids array<string>, state string, attempts int, last_error string, updated_at timestamp"
MARKERS = "project_id string, trace_id string, expired_at timestamp"
PREPARED, FENCED, DELETING, DONE = "prepared", "fenced", "deleting", "done"
#: Objects, bytes and trace ids of one preparation; intents of one execution; diagnostics of an object.
MOST_OBJECTS, MOST_BYTES, MOST_TRACES, MOST_INTENTS, MOST_DIAGNOSTICS = 100, 1 << 30, 10_000, 100, 1000

KEY = ["project_id", "object_key"]


def log(store: Store) -> Ledger:
    return Ledger(store.spark, store.at("raw_retention"), INTENTS)


def prepare(book: Ledger, candidates: DataFrame, now: datetime, most_objects: int = MOST_OBJECTS, most_bytes: int = MOST_BYTES, most_traces: int = MOST_TRACES) -> int:
    """Adds intents for ``candidates`` (project_id, object_key, size, trace_ids and the facts of
    ``state.expiry_vetoes``) that nothing speaks against, in order of their keys while the caps hold; the rest is left
    for the next preparation. An object gets one intent ever. How many were added."""
    added = []

    def change(known: DataFrame) -> DataFrame:
        free = state.new_intents(known, state.expiry_vetoes(candidates).where("reason is null"))
        bounded = free.select(*KEY, "size", "trace_ids").orderBy(*KEY).limit(most_objects).collect()
        taken, size, traces = [], 0, 0
        for c in bounded:
            size, traces = size + c.size, traces + len(c.trace_ids)
            if size > most_bytes or traces > most_traces:
                break
            taken.append((c.project_id, uuid.uuid4().hex, c.object_key, c.size, sorted(c.trace_ids), PREPARED, 0, None, now))
        added[:] = taken
        return known.unionByName(book.spark.createDataFrame(taken, INTENTS))

    book.update(change)
    return len(added)


def _move(book: Ledger, ids: list[str], to: str, now: datetime, errors: dict[str, str] | None = None) -> None:
    told = book.spark.createDataFrame([(i, (errors or {}).get(i)) for i in ids], "intent_id string, _error string")

    def change(known: DataFrame) -> DataFrame:
        joined = known.join(F.broadcast(told.withColumn("_mine", F.lit(True))), "intent_id", "left")  # MOST_INTENTS rows
        mine = F.coalesce("_mine", F.lit(False))
        put = lambda c, v: F.when(mine, v).otherwise(F.col(c))
        tries = F.when(mine & F.col("_error").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts"))
        return joined.withColumns({"state": put("state", F.lit(to)), "last_error": put("last_error", F.col("_error")), "attempts": tries, "updated_at": put("updated_at", F.lit(now))})

    if ids:
        book.update(change)


def fenced(book: Ledger) -> DataFrame:
    """(project_id, object_key) that readers are to treat as gone."""
    return book.read().where(F.col("state").isin(FENCED, DELETING, DONE)).select(*KEY)


def execute(store: Store, ids: list[str], facts: Callable[[DataFrame], DataFrame], root: str, now: datetime) -> dict[str, str]:
    """Carries out the named intents: {intent_id: done, already_done, or the reason that spoke against it}.

    ``facts(intents)`` gives the intents with the facts of ``state.expiry_vetoes`` as they are now and ``size_now``
    (null if the object is gone); it is asked again after the fence stands and before anything is deleted. A refused
    intent goes back to prepared with its reason. ``root`` is the folder of raw objects."""
    if not 1 <= len(set(ids)) == len(ids) <= MOST_INTENTS:
        raise ValueError(f"between 1 and {MOST_INTENTS} different intents")
    book = log(store)
    mine = lambda: {r.intent_id: r for r in book.read().where(F.col("intent_id").isin(ids)).collect()}
    found = mine()
    if len(found) < len(ids):
        raise ValueError("unknown intents")
    out = {i: "already_done" for i, r in found.items() if r.state == DONE}
    _move(book, [i for i, r in found.items() if r.state == PREPARED], FENCED, now)
    waiting = book.read().where(F.col("intent_id").isin(ids) & (F.col("state") == FENCED))
    changed = F.when(F.col("size_now").isNull(), "object_missing").when(F.col("size_now") != F.col("size"), "object_changed")
    told = state.expiry_vetoes(facts(waiting)).select("intent_id", F.coalesce("reason", changed).alias("reason")).collect() if any(r.state in (PREPARED, FENCED) for r in found.values()) else []
    refused = {r.intent_id: r.reason for r in told if r.reason}
    _move(book, list(refused), PREPARED, now, refused)
    _move(book, [r.intent_id for r in told if not r.reason], DELETING, now)
    out.update(refused)
    going = [r for r in mine().values() if r.state == DELETING]
    for r in going:
        store.files.delete(f"{root.rstrip('/')}/{r.object_key}")
    if going:
        _expire(store, going, now)
    _move(book, [r.intent_id for r in going], DONE, now)
    return out | {r.intent_id: "done" for r in going}


def markers(store: Store) -> DataFrame:
    """(project_id, trace_id, expired_at): traces of which raw objects were expired on purpose. Nothing removes them."""
    return store.read("raw_trace_retention", MARKERS).groupBy("project_id", "trace_id").agg(F.min("expired_at").alias("expired_at"))


def _expire(store: Store, going: list, now: datetime) -> None:
    """Adds what is missing of the markers and of the expired references."""
    spark: SparkSession = store.spark
    given = spark.createDataFrame([(r.project_id, t, r.updated_at) for r in going for t in r.trace_ids], MARKERS).distinct()
    new = given.join(store.read("raw_trace_retention", MARKERS), ["project_id", "trace_id"], "left_anti")
    new.groupBy("project_id", "trace_id").agg(F.min("expired_at").alias("expired_at")).write.mode("append").parquet(store.at("raw_trace_retention"))
    objects = spark.createDataFrame([(r.project_id, r.object_key) for r in going], "project_id string, object_key string")
    known = store.read("raw_event_refs", REFS)
    left = known.join(refs.expired(known).select(*refs.KEY), refs.KEY, "left_anti")
    rows = refs.expire(left, objects, now)
    rows.select("project_id", "trace_id", "object_key", "received_at", "event_ts", "applied").write.mode("append").parquet(store.at("raw_event_refs"))


def diagnostics(failures: DataFrame, sidecars: DataFrame, cutoff: datetime, most: int = MOST_DIAGNOSTICS) -> DataFrame:
    """(project_id, object_key, rows, action) for objects with failed events: delete only if the set is whole, that is
    if every event named by the object's sidecar has its row and the other way round; else the reason to leave all of
    them. ``sidecars``: (project_id, object_key, body), the JSON that stands beside a failed object."""
    named = sidecars.withColumn("events", F.from_json("body", "struct<events:array<string>>")["events"])
    beside = named.groupBy(*KEY).agg(F.count_if(F.col("events").isNull()).alias("invalid"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("events")))).alias("named"))  # one sidecar an object
    rows = failures.groupBy(*KEY).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("event_id")).alias("held"), F.max("created_at").alias("last"))
    reason = (
        F.when(F.col("named").isNull() & F.col("invalid").isNull(), "sidecar_missing").when(F.col("invalid") > 0, "sidecar_invalid").when(F.col("rows") > most, "row_cap")
        .when(F.col("last") >= F.lit(cutoff), "inside_window").when(F.col("named") != F.col("held"), "sets_differ").otherwise("delete")
    )
    return rows.join(beside, KEY, "left").select(*KEY, "rows", reason.alias("action"))
