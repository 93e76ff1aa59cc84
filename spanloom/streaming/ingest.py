"""Micro-batch ingest: landed batches become versions of traces, observations and scores.

Every file is read at least once. A row's version is its batch's receive time, so that a replay writes the
same versions again and reading sees them once. Whole rows replace what is stored, unless that is newer. Rows of
a compatible client hold only what it sent: they are merged with the stored row field by field, and the time
that each field was received is kept beside it; a whole row of the same micro-batch counts as stored. Writes go in
this order: references as pending, rows with the deletions of moved rows, the registry of environments, the feeds,
references as applied, times of fields. A failure in between leaves the references pending, which hides the traces
from feeds until the batch is replayed.

A batch is published when its rows are written, at a time of its project that is later than all before: a batch that
was received early and written late comes after the cursor of who has read the feed meanwhile.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import pricing
from spanloom.operators import environments, moved, refs, settlement, versions
from spanloom.schemas import INGEST_BATCH, RECORD, SORT_TIME, TABLES, struct_of
from spanloom.sources import compat, native, otlp, raw
from spanloom.streaming.ledger import Ledger
from spanloom.streaming.store import FIELD_TIMES, SCORE_FEED, Store, trace_of  # noqa: F401


REFS = "project_id string, trace_id string, object_key string, received_at timestamp, event_ts timestamp, applied tinyint"
CLOCK = "project_id string, published_at timestamp"
ENVIRONMENTS = "project_id string, name string, first_seen_at timestamp, last_seen_at timestamp, hidden boolean"
FAILED = "project_id string, batch_id string, object_key string, event_id string, event_type string, source string, stage string, message string, created_at timestamp"


BATCH = ["project_id", "batch_id"]
EVENT = [*BATCH, "ordinal"]


def mapped(events: DataFrame) -> dict[str, DataFrame]:
    """Rows of all sources by table; ``event_ts`` is their version and ``seq`` their order. Nothing stored is looked at."""
    spans, requests = otlp.spans(events), compat.events(events)
    rows = {k: v.drop("batch_id") for k, v in whole_rows(events, spans, requests).items()}
    for kind, df in partial_rows(requests).items():
        rows[kind] = rows[kind].unionByName(_shaped(folded(df, kind).withColumn("seq", F.lit(0)), kind))
    return rows


#: The events of each shape: what a batch lacks isn't planned at all.
NATIVE = {"traces": "trace-upsert", "observations": "observation-upsert", "scores": "score-upsert"}
EXPORT, COMPAT = "otlp-export", "langfuse-ingestion"
ALL = frozenset([*NATIVE.values(), EXPORT, COMPAT])


def whole_rows(events: DataFrame, spans: DataFrame, requests: DataFrame, present: frozenset = ALL) -> dict[str, DataFrame]:
    """Rows that replace what is stored, with their batch_id. Of a span that comes twice the last counts."""
    order = lambda df, by: df.withColumn("seq", F.col(by).cast("long"))
    newest = W.partitionBy("project_id", "trace_id", "id").orderBy(F.desc("received_at"), F.desc("place"))

    def observed_spans() -> DataFrame:
        return otlp.observations(spans).withColumn("_n", F.row_number().over(newest)).where("_n = 1")

    parts = {
        "traces": [(NATIVE["traces"], lambda: order(native.traces(events), "ordinal")), (EXPORT, lambda: otlp.traces(spans).withColumn("seq", F.lit(0)))],
        "observations": [(NATIVE["observations"], lambda: order(native.observations(events), "ordinal")), (EXPORT, lambda: order(observed_spans(), "place.ordinal"))],
        "scores": [(NATIVE["scores"], lambda: order(native.scores(events), "ordinal")), (COMPAT, lambda: order(compat.scores(requests), "ordinal"))],
    }
    made = {k: [_shaped(rows(), k, "batch_id") for kind, rows in found if kind in present] for k, found in parts.items()}
    return {k: reduce(DataFrame.unionByName, v) for k, v in made.items() if v}


def partial_rows(requests: DataFrame) -> dict[str, DataFrame]:
    """Rows a compatible client sent parts of, one a record and request."""
    return {"traces": compat.traces(requests), "observations": compat.observations(requests)}


def folded(rows: DataFrame, kind: str) -> DataFrame:
    """One row a record, in the order of receipt, with ``times``: when each sent field was last received."""
    key = _key(kind)
    sent = rows.select(*key, "received_at", F.explode("provided").alias("field")).groupBy(*key, "field").agg(F.max("received_at").alias("at"))
    times = sent.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", "at"))).alias("times"))  # an entry a column
    ordered = rows.withColumn("ordinal", F.struct("received_at", "batch_id", "ordinal"))
    return compat.fold_requests(ordered, key).join(times, key, "left")


def _key(kind: str) -> list[str]:
    return ["project_id", *RECORD[kind]]


def _shaped(rows: DataFrame, kind: str, *more: str) -> DataFrame:
    fields = [f for f in struct_of(TABLES[kind]) if f.name not in ("event_ts", "is_deleted")]
    own = [(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
    return rows.select(*own, F.col("received_at").alias("event_ts"), F.lit(False).alias("is_deleted"), *more)


def _traces_of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("project_id", trace_of(kind).alias("trace_id")).distinct()


def merged_rows(store: Store, kind: str, rows: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Rows of ``folded`` put together with the newest stored ones (``whole`` rows of the same micro-batch among
    them), and ``sent_at``, the times of their fields.

    A row received before the stored version takes that version, and the next ``seq`` of it."""
    key = _key(kind)
    fields = [f.name for f in struct_of(TABLES[kind]) if f.name not in (*key, "event_ts", "is_deleted", "seq")]
    mine = _shaped(rows.withColumn("seq", F.lit(0)), kind, "received_at", "provided", "times")
    asked = mine.select(*key)
    traces = _traces_of(mine, kind)
    recorded = _of_kind(store.of_traces("field_times", traces), kind).join(asked, key, "left_semi")
    times = recorded.groupBy(*key).agg(F.max_by("sent_at", F.struct("event_ts", "seq")).alias("sent_at"))
    kept = store.of_traces(kind, traces)
    kept = kept if whole is None else kept.unionByName(whole.select(*kept.columns))
    stored = versions.of_ids(kept, asked, kind).join(times, key, "left")
    made = moved.by_recency(mine, stored, key, fields, F.col("received_at"), F.col("times"))
    held = stored.select(*key, F.col("event_ts").alias("_version"), F.col("seq").alias("_seq"))
    made = made.join(mine.select(*key, "received_at", "provided"), key).join(held, key, "left")
    if kind == "observations":
        made = moved.consistent_cost(made)
    late = F.coalesce(F.col("_version") >= F.col("received_at"), F.lit(False))
    made = made.withColumns({"event_ts": F.greatest("received_at", "_version"), "seq": F.when(late, F.coalesce("_seq", F.lit(0)) + 1).otherwise(0), "is_deleted": F.lit(False)})
    return made.select(*struct_of(TABLES[kind]).names, "sent_at")


def _of_kind(times: DataFrame, kind: str) -> DataFrame:
    return times.where(F.col("kind") == kind[:-1])


def _records(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the columns of ``moved.RECORD_KEY`` and sort_time."""
    rows = rows.withColumn("trace_id", F.lit("")) if kind == "traces" else rows
    return rows.withColumns({"kind": F.lit(kind[:-1]), "sort_time": F.col(SORT_TIME[kind])})


def settled_rows(store: Store, kind: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to write, tombstones): late rows of whole records aren't written, rows left on other days go."""
    mine = _records(rows, kind).withColumn("ordinal", F.struct("event_ts", "seq"))
    live = versions.latest(store.of_traces(kind, _traces_of(rows, kind)).join(rows.select(*_key(kind)), _key(kind), "left_semi"), kind)
    written, gone = moved.resolve(mine, _records(live, kind))
    names = struct_of(TABLES[kind]).names
    return written.select(*names), versions.tombstones(gone, F.col("_at")).withColumn("seq", F.lit(1 << 40)).select(*names)


def bad_exports(spans: DataFrame) -> DataFrame:
    """(project_id, batch_id, ordinal) of exports that fail for the times of a span."""
    return otlp.unmapped(spans).select(*BATCH, F.col("place.ordinal").alias("ordinal")).distinct()


def failures(events: DataFrame, bad: DataFrame | None, requests: DataFrame | None) -> DataFrame:
    """Dead letters of all sources: native events, whole exports, single events of compatible requests."""
    sent = events.select(*EVENT, "object_key", F.col("id").alias("event"), "source")
    shape = [*BATCH, "object_key", "event_id", "event_type", "source", "message"]
    found = [native.errors(events)]
    if bad is not None:
        found.append(sent.join(bad, EVENT).withColumns({"event_id": F.col("event"), "event_type": F.lit(EXPORT), "message": F.lit("a span's times are no unsigned nanoseconds")}).select(*shape))
    if requests is not None:
        found.append(sent.join(compat.responses(requests).where("status = 400").select(*EVENT, "event_id", "message"), EVENT).withColumn("event_type", F.lit(COMPAT)).select(*shape))
    return raw.dead_letters(reduce(DataFrame.unionByName, found), None).withColumn("created_at", F.current_timestamp())


def _touched(store: Store, whole: dict[str, DataFrame], spans: DataFrame | None, parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(project_id, batch_id, trace_id) that rows concern, and those that only scores do; late rows count too."""
    of = lambda df, trace: df.select(*BATCH, F.col(trace).alias("trace_id"))
    found = [of(v, "id" if k == "traces" else "trace_id") for rows in (whole, parts) for k, v in rows.items() if k != "scores"]
    found += [] if spans is None else [of(spans, "span.traceId")]
    none = store.spark.createDataFrame([], "project_id string, batch_id string, trace_id string")
    rows = reduce(DataFrame.unionByName, found, none).distinct()
    return rows, (of(whole["scores"], "trace_id").distinct().join(rows, [*BATCH, "trace_id"], "left_anti") if "scores" in whole else none)


def published(store: Store, links: DataFrame, scored: DataFrame) -> None:
    """Adds a micro-batch's activities to both feeds. The batches of a project get rising times, the later of now and
    a microsecond after the project's last; the clock moves before the feeds are written, so that no time is given
    twice. An activity that the trace feed has stays where it is; scores that are written again are sent again."""
    feed = links.groupBy("project_id", "trace_id", F.col("batch_id").alias("activity_id")).agg(F.max("event_ts").alias("version"))
    held = store.of_traces("trace_feed", links.select("project_id", "trace_id"))
    feed = feed.join(held, ["project_id", "trace_id", "activity_id"], "left_anti")
    clock = Ledger(store.spark, store.at("feed_clock"), CLOCK)
    received = lambda df: df.groupBy("project_id", "batch_id").agg(F.min("received_at").alias("at"))
    fresh = feed.select("project_id", F.col("activity_id").alias("batch_id")).distinct()
    batches = received(links).join(fresh, BATCH, "left_semi").withColumn("feed", F.lit(0)).unionByName(received(scored).withColumn("feed", F.lit(1)))
    batches = batches.select("project_id", "batch_id", F.col("feed").cast("string").alias("trace_id"), F.struct("at", "batch_id", "feed").alias("activity_id"), F.current_timestamp().alias("received_at"))
    given: list[DataFrame] = []

    def tick(last: DataFrame) -> DataFrame:
        known = last.select("project_id", F.col("published_at").alias("last"))
        ticks = settlement.publication_clock(batches.join(known, "project_id", "left"), F.col("last")).select("project_id", "batch_id", F.col("trace_id").cast("int").alias("feed"), "published_at")
        given[:] = [store.spark.createDataFrame(ticks.toArrow())]  # a row a batch file of the micro-batch
        return last.unionByName(given[0].select("project_id", "published_at")).groupBy("project_id").agg(F.max("published_at").alias("published_at"))

    clock.update(tick)
    times = given[0]
    at = times.where("feed = 0").select("project_id", F.col("batch_id").alias("activity_id"), "published_at")
    rows = feed.join(F.broadcast(at), ["project_id", "activity_id"])
    store.append("trace_feed", rows)
    sent = scored.select(*BATCH, "trace_id").join(F.broadcast(times.where("feed = 1")), BATCH)
    store.append("score_feed", sent.groupBy("project_id", "trace_id").agg(F.max("published_at").alias("published_at")))
    clock.forget()


def registry(store: Store) -> Ledger:
    """The environments that each project's traces name, at most ``environments.CAPACITY`` a project."""
    return Ledger(store.spark, store.at("environments"), ENVIRONMENTS)


def observed(store: Store, traces: DataFrame) -> None:
    """Adds the environments of written traces to the registry; a commit notes how many names found no room."""
    seen = environments.statistics(traces.where("not is_deleted"))
    if not seen.head(1):
        return

    def change(known: DataFrame) -> tuple[DataFrame, dict]:
        after = environments.admitted(known, seen)
        return after, {"refused": seen.join(after, ["project_id", "name"], "left_anti").count()}

    book = registry(store)
    book.update(change)
    book.forget()


def rebuild_registry(store: Store, watermark) -> int:
    """The registry anew from the stored traces; hidden names stay hidden. If the stream commits while this reads,
    it reads again, so a rebuild beside a running stream ends like one after it."""

    def change(known: DataFrame) -> tuple[DataFrame, dict]:
        hidden = known.where("hidden").select("project_id", "name", "hidden")
        built = environments.rebuilt(versions.latest(store.read("traces"), "traces"), watermark)
        return built.join(hidden, ["project_id", "name"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(False))), {"rebuilt": True}

    return registry(store).update(change)


def write_batch(store: Store, batches: DataFrame, prices: DataFrame | None = None, overrides: DataFrame | None = None) -> None:
    """Maps and writes one micro-batch of batch files. What it staged goes, whether it ends well or not."""
    batch = f"_staged/{uuid.uuid4().hex}"
    try:
        _write_staged(store, batch, batches, prices, overrides)
    finally:
        store.forget(batch)


def _write_staged(store: Store, batch: str, batches: DataFrame, prices: DataFrame | None, overrides: DataFrame | None) -> None:
    staged = lambda df: store.staged(df, batch)
    events = staged(raw.events(batches))
    present = frozenset(r.type for r in events.where(F.col("type").isin(*ALL)).select("type").distinct().collect())
    requests = staged(compat.events(events)) if COMPAT in present else None
    bad = spans = None
    if EXPORT in present:
        all_spans = staged(otlp.spans(events))
        bad = staged(bad_exports(all_spans))
        spans = all_spans.withColumn("ordinal", F.col("place.ordinal")).join(bad, EVENT, "left_anti").drop("ordinal")
    whole = {k: staged(v) for k, v in whole_rows(events, spans, requests, present).items()}
    parts = {k: staged(v) for k, v in partial_rows(requests).items()} if requests is not None else {}
    touched, scored = _touched(store, whole, spans, parts)
    keys = events.select(*BATCH, "object_key", "received_at", F.col("received_at").alias("event_ts")).distinct()
    links = staged(touched.join(keys, BATCH))
    scored = staged(scored.join(keys, BATCH))
    columns = ["project_id", "trace_id", "object_key", "received_at", "event_ts", "applied"]
    refs.new_refs(links, refs.PENDING).select(*columns).unionByName(refs.new_refs(scored, refs.APPLIED).select(*columns)).write.mode("append").parquet(store.at("raw_event_refs"))
    times = []
    for kind in [k for k in TABLES if k in whole or k in parts]:
        rows = whole[kind].drop("batch_id") if kind in whole else None
        if kind in parts:
            made = staged(merged_rows(store, kind, staged(folded(parts[kind], kind)), rows))
            times.append(_records(made, kind).select(*struct_of(FIELD_TIMES).names))
            rows = made.drop("sent_at") if rows is None else rows.unionByName(made.drop("sent_at"))
        written, gone = settled_rows(store, kind, rows)
        if kind == "observations" and prices is not None:
            written = pricing.enrich(written, overrides, prices)
        out = staged(written.unionByName(gone))
        store.append(kind, out)
        if kind == "traces":
            observed(store, out)
    published(store, links, scored)
    failures(events, bad, requests).write.mode("append").parquet(store.at("ingest_failures"))
    refs.new_refs(links, refs.APPLIED).select(*columns).write.mode("append").parquet(store.at("raw_event_refs"))
    for rows in times:
        store.append("field_times", rows)


def start(store: Store, landing: str, checkpoint: str, available_now: bool = True, **prices: DataFrame):
    """A streaming query from landed batch files to the tables. State is the checkpoint alone; no watermark
    drops late rows, since they reopen their trace instead."""
    source = store.spark.readStream.schema(f"{INGEST_BATCH}, broken string").option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "broken").json(landing)
    keyed = source.withColumn("object_key", F.regexp_extract(F.col("_metadata.file_path"), r"(raw/.*)$", 1))
    writer = keyed.writeStream.foreachBatch(lambda df, _: write_batch(store, df, **prices)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def unfinished(store: Store) -> DataFrame:
    """Raw objects that a failed batch left pending; they are to be landed again."""
    return refs.pending(store.read("raw_event_refs", REFS)).select("project_id", "object_key").distinct()


def current_feed(store: Store, since: datetime | None = None) -> DataFrame:
    """One row a trace, in the place of its last activity. ``since`` leaves out what was published before, and with it
    the months before: times only rise, so the last activity of a trace that has one later is among the later rows."""
    return settlement.publish(store.read_since("trace_feed", since))


def current_score_feed(store: Store, since: datetime | None = None) -> DataFrame:
    """(project_id, trace_id, published_at): traces with new scores, each in its last place."""
    return store.read_since("score_feed", since).groupBy("project_id", "trace_id").agg(F.max("published_at").alias("published_at"))
