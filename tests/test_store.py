"""The keyed store, ledgers, publication in commit order, and the registry of environments at ingest."""

import json
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_ingest import compat_batch, event, land, run

from spanloom.operators import environments, versions
from spanloom.streaming import ingest, ledger
from spanloom.streaming.ledger import Ledger
from spanloom.streaming.store import FEED, SCORE_FEED, Store


def trace(i, day, name="n", project="p1", environment=None):
    at = datetime(2020, 1, 1) + timedelta(days=day)
    return (project, i, at, name, environment, at)


def rows(spark, given):
    df = spark.createDataFrame(given, "project_id string, id string, timestamp timestamp, name string, environment string, event_ts timestamp")
    return df.withColumns({"is_deleted": F.lit(False), "seq": F.lit(0).cast("long")})


def test_few_traces_open_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    given = [trace(f"t{i}", i % 1000) for i in range(4000)]
    store.append("traces", rows(spark, given))
    assert Store(spark, str(tmp_path), buckets=3).buckets == 16  # fixed at first use
    asked = [(f"t{i}",) for i in range(7, 4000, 400)]
    found = store.of_traces("traces", spark.createDataFrame(asked, "trace_id string").withColumn("project_id", F.lit("p1")))
    assert sorted(r.id for r in found.collect()) == sorted(x for x, in asked) and len(asked) == 10
    whole = store.read("traces").inputFiles()
    assert len(whole) >= 400 and len(found.inputFiles()) <= 0.05 * len(whole)
    nobody = spark.createDataFrame([("p2", "t7"), ("p1", "none"), (None, "t7"), ("p1", None)], "project_id string, trace_id string")
    assert store.of_traces("traces", nobody).count() == 0
    many = store.read("traces").select("project_id", F.col("id").alias("trace_id"))
    assert store.of_traces("traces", many).count() == 4000


def test_keys_in_several_months_and_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    for day in (0, 40, 80, 80, 80):
        store.append("traces", rows(spark, [trace("a", day, f"day {day}"), trace("b", 0, f"was {day}").__class__(("p1", "b", datetime(2020, 1, 1), f"was {day}", None, datetime(2020, 1, 1) + timedelta(days=day)))]))
    ids = spark.createDataFrame([("p1", "a"), ("p1", "b")], "project_id string, trace_id string")
    told = lambda: sorted((r.id, r.timestamp, r.name) for r in versions.latest(store.of_traces("traces", ids), "traces").collect())
    before, files = told(), len(store.read("traces").inputFiles())
    assert [x[2] for x in before] == ["day 0", "day 40", "day 80", "was 80"]
    assert store.compact("traces", datetime(2019, 1, 1), least_files=2) >= 1
    assert told() == before and len(store.read("traces").inputFiles()) < files
    assert store.read("traces").count() == 4 and store.compact("traces", datetime(2019, 1, 1), least_files=2) == 0


def test_feeds_from_a_time_on_open_later_months_only(spark, tmp_path):
    store, at = Store(spark, str(tmp_path), buckets=2), lambda m, d=1: datetime(2024, m, d)
    store.append("trace_feed", spark.createDataFrame([("p", i, f"{i}{m}", at(m), at(m, d)) for i, m, d in (("a", 1, 1), ("b", 2, 1), ("a", 3, 1), ("c", 3, 2), ("d", 4, 1))], FEED))
    told = lambda since: sorted((r.published_at, r.trace_id) for r in ingest.current_feed(store, since).collect())
    whole = told(None)
    assert whole == [(at(2), "b"), (at(3), "a"), (at(3, 2), "c"), (at(4), "d")]
    assert told(at(3, 2)) == whole[2:] and told(at(5)) == []
    assert len(store.read_since("trace_feed", at(4)).inputFiles()) == 1 < len(store.read("trace_feed").inputFiles())
    store.append("score_feed", spark.createDataFrame([("p", "a", at(1)), ("p", "a", at(1, 2)), ("p", "b", at(2))], SCORE_FEED))
    store.append("score_feed", spark.createDataFrame([("p", "a", at(1, 3))], SCORE_FEED))
    assert store.compact("score_feed", at(1), least_files=2) == 1 and store.read("score_feed").count() == 2
    assert [(r.trace_id, r.published_at) for r in ingest.current_score_feed(store, at(1, 2)).orderBy("trace_id").collect()] == [("a", at(1, 3)), ("b", at(2))]


def test_ledger_commits_only_after_what_was_seen(spark, tmp_path, monkeypatch):
    book = Ledger(spark, str(tmp_path / "book"), "k string, n long")
    one = lambda n: spark.createDataFrame([("a", n)], "k string, n long")
    assert book.last() == 0 and book.read().count() == 0
    assert book.commit(one(1), 0) and not book.commit(one(9), 0)
    book.files.create(str(tmp_path / "book/commits/000000000002"), "")  # a writer that died
    assert book.last() == 1 and not book.commit(one(2), 1)  # it may still be at work
    monkeypatch.setattr(ledger, "GRACE", 0)
    assert book.commit(one(2), 1, {"by": "x"}) and book.last() == 3 and book.entry(3)["by"] == "x"
    monkeypatch.undo()

    def add(known):
        return known.withColumn("n", F.col("n") + 1)

    threads = [threading.Thread(target=book.update, args=(add,)) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert book.read().first().n == 5
    book.forget(1)
    assert book.read().first().n == 5 and len(book.files.listed(str(tmp_path / "book/rows"))) == 1


def upsert(i, environment=None, name="n"):
    return event(1, "trace-upsert", "native", {"id": i, "timestamp": "2024-05-01T09:00:00Z", "name": name, **({"environment": environment} if environment else {})})


def test_feed_follows_the_order_of_writing(spark, tmp_path):
    landing, store = tmp_path / "land", Store(spark, str(tmp_path / "store"), buckets=4)
    land(landing, "b2", [upsert("t1")], at="2024-05-01T10:05:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    (seen,) = ingest.current_feed(store).collect()
    cursor = (seen.published_at, seen.trace_id)
    land(landing, "b1", [upsert("t0"), upsert("t1", name="late")], at="2024-05-01T10:00:00.000Z")  # received before, written after
    land(landing, "b0", [upsert("t2")], at="2024-05-01T09:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    news = sorted((r.published_at, r.trace_id, r.activity_id) for r in ingest.current_feed(store).collect() if (r.published_at, r.trace_id) > cursor)
    assert [x[1:] for x in news] == [("t2", "b0"), ("t0", "b1"), ("t1", "b1")] and news[1][0] == news[2][0] > news[0][0]
    run(spark, store, landing, tmp_path / "again")  # a replay of everything moves nothing
    assert sorted((r.published_at, r.trace_id, r.activity_id) for r in ingest.current_feed(store).collect() if (r.published_at, r.trace_id) > cursor) == news


def test_clock_rises_when_the_time_does_not(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    ahead = datetime.now() + timedelta(days=1)
    clock = Ledger(spark, store.at("feed_clock"), ingest.CLOCK)
    clock.commit(spark.createDataFrame([("p1", ahead)], ingest.CLOCK), 0)
    land(tmp_path / "land", "b1", [upsert("t1")])
    land(tmp_path / "land", "b2", [upsert("t2")], at="2024-05-01T11:00:00.000Z")
    run(spark, store, tmp_path / "land", tmp_path / "ck")
    got = {r.trace_id: r.published_at for r in ingest.current_feed(store).collect()}
    assert got == {"t1": ahead + timedelta(microseconds=1), "t2": ahead + timedelta(microseconds=2)} and clock.read().first().published_at == got["t2"]


def test_registry_of_the_stream_and_a_rebuild_beside_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(environments.admitted, "__defaults__", (2,))
    landing, store = tmp_path / "land", Store(spark, str(tmp_path / "store"), buckets=4)
    land(landing, "b1", [upsert("t1", "prod"), upsert("t2", "dev")])
    run(spark, store, landing, tmp_path / "ck")
    book = ingest.registry(store)
    hide = lambda known: environments.set_hidden(known, "p1", "dev", True)
    book.update(hide)
    land(landing, "b2", [upsert("t3", "full"), upsert("t4", "dev")], at="2024-05-01T11:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    told = lambda: sorted((r.name, r.hidden) for r in book.read().collect())
    assert told() == [("dev", True), ("prod", False)] and book.entry(book.last())["refused"] == 1
    rebuilt, reads = environments.rebuilt, []

    def beside(traces, watermark):  # while the rebuild reads for the first time, the stream writes
        if not reads:
            reads.append(1)
            store.append("traces", rows(spark, [trace("t9", 2000, environment="new")]))
            out = rebuilt(traces.limit(0), watermark, 5)
            ingest.observed(store, rows(spark, [trace("t9", 2000, environment="new")]))
            return out
        return rebuilt(traces, watermark, 5)

    monkeypatch.setattr(environments, "rebuilt", beside)
    ingest.rebuild_registry(store, datetime(2020, 1, 1))
    assert told() == [("dev", True), ("full", False), ("new", False), ("prod", False)]


def test_whole_and_part_of_one_batch_meet(spark, tmp_path):
    landing, store = tmp_path / "land", Store(spark, str(tmp_path / "store"), buckets=4)
    whole = event(1, "observation-upsert", "native", {"id": "g1", "traceId": "t1", "type": "generation", "startTime": "2024-05-01T09:00:00Z", "model": "m", "name": "whole"})
    land(landing, "b1", [whole])
    land(landing, "b2", [compat_batch(("generation-update", {"id": "g1", "traceId": "t1", "output": "part"}))], at="2024-05-01T11:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")  # one micro-batch
    (o,) = versions.latest(store.read("observations"), "observations").collect()
    assert (o.model, o.name, json.loads(o.output), o.start_time.hour) == ("m", "whole", "part", 9)


def test_failed_batch_leaves_nothing_staged(spark, tmp_path, monkeypatch):
    landing, store = tmp_path / "land", Store(spark, str(tmp_path / "store"), buckets=4)
    land(landing, "b1", [upsert("t1")])
    monkeypatch.setattr(ingest, "settled_rows", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run(spark, store, landing, tmp_path / "ck")
    assert store.files.listed(store.at("_staged")) == [] and ingest.unfinished(store).count() == 1
    monkeypatch.undo()
    run(spark, store, landing, tmp_path / "ck")
    assert ingest.unfinished(store).count() == 0 and store.read("traces").count() == 1


def test_batches_that_map_to_nothing(spark, tmp_path):
    landing, store = tmp_path / "land", Store(spark, str(tmp_path / "store"), buckets=4)
    land(landing, "b1", [event(1, "strange", "native", {}), event(2, "trace-upsert", "native", "no json")])
    (landing / "raw/p1/2024/05/01/b2.json").write_text("{broken")
    run(spark, store, landing, tmp_path / "ck")
    failed = sorted((r.event_id, r.event_type) for r in store.read("ingest_failures", ingest.FAILED).collect())
    assert failed == [("e1", "strange"), ("e2", "trace-upsert")] and ingest.current_feed(store).count() == 0
    land(landing, "b3", [event(3, "score-upsert", "native", {"id": "s1", "traceId": "t1", "name": "good", "source": "api", "value": 1})], at="2024-05-01T11:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    assert [r.trace_id for r in ingest.current_score_feed(store).collect()] == ["t1"] and store.read("scores").count() == 1
