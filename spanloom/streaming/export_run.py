"""Export runs: what settled since the last run goes to a folder of the run's own, and counts once it is committed.

A run reads every table as of one listing of files, so that what it compares and what it writes are the same state.
It writes ``run-<id>/<table>`` and then one commit to the ledger of the export, which names the folder and moves the
cursors of both feeds. Whoever reads an export takes the folders that commits name. A run that dies before leaves the
cursors where they were, and its folder is named by nobody; a run that loses the race to another deletes its folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import settlement, versions
from spanloom.operators.filters import TraceFilter, matches_destination
from spanloom.operators.refs import pending
from spanloom.operators.state import EXPORT_RUN, EXPORT_SCAN
from spanloom.sources import export
from spanloom.streaming.ingest import REFS, Store, current_feed, current_score_feed
from spanloom.streaming.ledger import Files, Ledger

CURSORS = "feed_at timestamp, feed_id string, score_at timestamp, score_id string, run_again boolean"
ENTRY = "project_id string, trace_id string, version timestamp, published_at timestamp"


@dataclass
class Tables:
    """All versions of one project's rows, its feeds (one row a trace) and its traces with pending work."""

    traces: DataFrame
    observations: DataFrame
    scores: DataFrame
    feed: DataFrame
    score_feed: DataFrame
    pending: DataFrame

    @staticmethod
    def of(store: Store, project_id: str, book_path: str | None = None) -> Tables:
        """The project's tables. With the ledger of an export, of the feeds only what comes from its cursors on."""
        c = Ledger(store.spark, book_path, CURSORS).read().first() if book_path else None
        mine = lambda df: df.where(F.col("project_id") == project_id)
        refs = pending(store.read("raw_event_refs", REFS))
        return Tables(*(mine(d) for d in (store.read("traces"), store.read("observations"), store.read("scores"), current_feed(store, c and c.feed_at), current_score_feed(store, c and c.score_at), refs)))


@dataclass
class Pass:
    """Entries that a pass sends, where it ends, and whether more is waiting."""

    sent: list = field(default_factory=list)
    cursor: tuple | None = None
    backlog: bool = False


def _after(feed: DataFrame, cursor: tuple | None, most: int) -> list:
    """The next entries in feed order: one more than a run looks at."""
    if cursor is not None:
        at, name = F.col("published_at"), F.col("trace_id")
        feed = feed.where((at > F.lit(cursor[0])) | ((at == F.lit(cursor[0])) & (name > cursor[1])))
    return feed.orderBy("published_at", "trace_id").limit(most + 1).collect()


def _walk(entries: list, cursor: tuple | None, most: int, scan: int) -> Pass:
    out = Pass(cursor=cursor)
    for e in entries[:scan]:
        if e.status == "blocked":
            return out
        if e.status == "emit" and e.wanted:
            if len(out.sent) == most:
                out.backlog = True
                return out
            out.sent.append(e)
        out.cursor = (e.published_at, e.trace_id)
    out.backlog = len(entries) > scan
    return out


def _listed(spark: SparkSession, entries: list, ddl: str) -> DataFrame:
    return spark.createDataFrame([tuple(getattr(e, n) for n in spark.createDataFrame([], ddl).columns) for e in entries], ddl)


def trace_pass(spark: SparkSession, t: Tables, wanted: TraceFilter, cursor: tuple | None, settled_before: datetime, most: int = EXPORT_RUN, scan: int = EXPORT_SCAN) -> Pass:
    """Settled versions up to the first blocked entry; traces that the filter leaves out move the cursor too."""
    window = _listed(spark, _after(t.feed.select("project_id", "trace_id", "version", "published_at"), cursor, scan), ENTRY)
    ids = window.select("project_id", "trace_id")
    live = settlement.versioned(t.traces, t.observations, ids=ids)
    current = live.select("project_id", F.col("id").alias("trace_id"), F.col("trace_version").alias("version"))
    told = settlement.feed_status(window, current, t.pending, settled_before)
    fits = live.where(matches_destination(wanted)).select("project_id", F.col("id").alias("trace_id")).distinct().withColumn("wanted", F.lit(True))
    marked = told.join(fits, ["project_id", "trace_id"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    return _walk(marked.orderBy("published_at", "trace_id").collect(), cursor, most, scan)


def score_pass(spark: SparkSession, t: Tables, wanted: TraceFilter, cursor: tuple | None, most: int = EXPORT_RUN, scan: int = EXPORT_SCAN) -> Pass:
    """Traces whose scores alone changed, at once and not after a quiet period. A trace that isn't there yet is
    stepped over: its scores go out with it. The version is the published one, else the current one."""
    window = _listed(spark, _after(t.score_feed.select("project_id", "trace_id", F.lit(None).cast("timestamp").alias("version"), "published_at"), cursor, scan), ENTRY).drop("version")
    live = settlement.versioned(t.traces, t.observations, ids=window.select("project_id", "trace_id"))
    fits = live.where(matches_destination(wanted)).groupBy("project_id", F.col("id").alias("trace_id")).agg(F.max("trace_version").alias("current"))
    known = t.feed.select("project_id", "trace_id", F.col("version").alias("known"))
    marked = window.join(fits, ["project_id", "trace_id"], "left").join(known, ["project_id", "trace_id"], "left")
    marked = marked.select("*", F.coalesce("known", "current").alias("version"), F.col("current").isNotNull().alias("wanted"), F.lit("emit").alias("status"))
    return _walk(marked.orderBy("published_at", "trace_id").collect(), cursor, most, scan)


def _rows(spark: SparkSession, t: Tables, traces: Pass, scores: Pass) -> dict[str, DataFrame]:
    whole, more = _listed(spark, traces.sent, ENTRY), _listed(spark, scores.sent, ENTRY)
    of = lambda df, kind, ids, key: export.stamped(versions.latest(df.join(ids.select("project_id", F.col("trace_id").alias(key)), ["project_id", key], "left_semi"), kind), ids, key)
    alone = more.join(whole, ["project_id", "trace_id"], "left_anti")
    return {
        "traces": of(t.traces, "traces", whole, "id"), "observations": of(t.observations, "observations", whole, "trace_id"),
        "scores": of(t.scores, "scores", whole, "trace_id").unionByName(of(t.scores, "scores", alone, "trace_id")),
    }


def run(spark: SparkSession, book_path: str, out: str, t: Tables, settled_before: datetime, wanted: TraceFilter | None = None, form: str = "parquet",
        most: int = EXPORT_RUN, scan: int = EXPORT_SCAN) -> dict:
    """One run of the export whose ledger is at ``book_path``: {"run": folder or None, "traces", "scores", "again"}."""
    book, wanted = Ledger(spark, book_path, CURSORS), wanted or TraceFilter()
    seen = book.last()
    c = book.read(seen).first()
    first = trace_pass(spark, t, wanted, (c.feed_at, c.feed_id) if c and c.feed_at else None, settled_before, most, scan)
    second = score_pass(spark, t, wanted, (c.score_at, c.score_id) if c and c.score_at else None, most, scan)
    name = None
    if first.sent or second.sent:
        name = f"run-{uuid.uuid4().hex}"
        rows = _rows(spark, t, first, second)
        if form == "parquet":
            export.write_parquet(rows, f"{out}/{name}")
        else:
            export.write_json_lines(export.json_lines(rows["traces"], rows["observations"], rows["scores"]), f"{out}/{name}")
    again = first.backlog or second.backlog
    moved = spark.createDataFrame([(*(first.cursor or (None, None)), *(second.cursor or (None, None)), again)], CURSORS)
    note = {"run": name, "traces": len(first.sent), "scores": len(second.sent), "again": again}
    if not book.commit(moved, seen, note):
        if name:
            Files(spark).delete(f"{out}/{name}")
        raise RuntimeError("another run moved the cursors first")
    return note


def delivered(spark: SparkSession, book_path: str) -> list[dict]:
    """The notes of all committed runs that wrote something, in order."""
    book = Ledger(spark, book_path, CURSORS)
    notes = [book.entry(n) for n, size in book._numbers() if size]
    return [n for n in notes if n.get("run")]
