"""Export runs, evaluator cursors, exact versions and the expiry of raw objects."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import evaluator, refs
from spanloom.operators.filters import TraceFilter
from spanloom.schemas import TABLES
from spanloom.streaming import export_run, retention_log, retention_pass
from spanloom.streaming.ingest import REFS, SCORE_FEED, Store
from spanloom.streaming.ledger import Ledger
from spanloom.streaming.store import FEED

T0 = datetime(2024, 5, 1)
REF = "project_id string, trace_id string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def table(spark, kind, rows):
    """Rows as dicts; what they lack is null."""
    names = spark.createDataFrame([], TABLES[kind]).columns
    full = [{"project_id": "p", "is_deleted": False, "seq": 0, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], TABLES[kind])


def traces(spark, *rows):
    return table(spark, "traces", [{"id": i, "timestamp": T0, "user_id": u, "tags": [], "metadata": {}, "event_ts": at(v)} for i, u, v in rows])


def observations(spark, *rows):
    return table(spark, "observations", [{"id": i, "trace_id": t, "start_time": T0, "event_ts": at(v)} for i, t, v in rows])


def scores(spark, *rows):
    return table(spark, "scores", [{"id": i, "trace_id": t, "name": "n", "timestamp": T0, "event_ts": at(v)} for i, t, v in rows])


def feed(spark, *rows):
    return spark.createDataFrame([("p", i, f"a{n}", at(v), at(n)) for i, v, n in rows], FEED)


def tables(spark, pending=()):
    return export_run.Tables(
        traces(spark, ("a", "u", 1), ("b", "u", 2), ("c", "v", 3), ("d", "u", 4), ("e", "u", 50)), observations(spark, ("o1", "a", 1), ("o2", "b", 2)),
        scores(spark, ("s1", "a", 1), ("s2", "c", 1), ("s3", "d", 9)), feed(spark, ("a", 1, 10), ("b", 2, 11), ("c", 3, 12), ("gone", 3, 13), ("d", 4, 14), ("e", 50, 15)),
        spark.createDataFrame([("p", "a", at(20)), ("p", "nowhere", at(21))], SCORE_FEED), spark.createDataFrame([("p", x) for x in pending], REF),
    )


def read(spark, out, name, kind):
    path = f"{out}/{name}/{kind}"
    return sorted(r.id for r in spark.read.parquet(path).collect()) if os.path.exists(path) else []


def test_export_runs(spark, tmp_path):
    book, out, by = str(tmp_path / "book"), str(tmp_path / "out"), TraceFilter(user_id="u")
    one = export_run.run(spark, book, out, tables(spark), at(30), by, most=2)
    assert (one["traces"], one["scores"], one["again"]) == (2, 1, True)
    assert [read(spark, out, one["run"], k) for k in ("traces", "observations", "scores")] == [["a", "b"], ["o1", "o2"], ["s1"]]
    version = spark.read.parquet(f"{out}/{one['run']}/traces").where("id = 'b'").first().trace_version
    assert version == at(2)
    two = export_run.run(spark, book, out, tables(spark), at(30), by, most=2)
    assert (two["traces"], two["scores"], two["again"]) == (1, 0, False) and read(spark, out, two["run"], "traces") == ["d"]
    three = export_run.run(spark, book, out, tables(spark), at(30), by)  # e isn't settled
    assert three["run"] is None
    cursor = Ledger(spark, book, export_run.CURSORS).read().first()
    assert (cursor.feed_id, cursor.score_id) == ("d", "nowhere")
    four = export_run.run(spark, book, out, tables(spark), at(60), by, form="lines")
    assert four["traces"] == 1 and spark.read.text(f"{out}/{four['run']}").count() == 1
    assert [n["run"] for n in export_run.delivered(spark, book)] == [one["run"], two["run"], four["run"]]


def test_export_run_that_dies_doubles_nothing(spark, tmp_path, monkeypatch):
    book, out = str(tmp_path / "book"), str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            export_run.run(spark, book, out, tables(spark), at(30))
    assert export_run.delivered(spark, book) == [] and len(os.listdir(out)) == 1  # written, named by nobody
    note = export_run.run(spark, book, out, tables(spark), at(30))
    assert read(spark, out, note["run"], "traces") == ["a", "b", "c", "d"] and len(export_run.delivered(spark, book)) == 1
    commit, raced = Ledger.commit, []

    def late(self, rows, seen, note):  # another run comes first
        if not raced:
            raced.append(1)
            export_run.run(spark, book, out, tables(spark), at(60))
        return commit(self, rows, seen, note)

    monkeypatch.setattr(Ledger, "commit", late)
    with pytest.raises(RuntimeError, match="first"):
        export_run.run(spark, book, out, tables(spark), at(60))
    assert len(export_run.delivered(spark, book)) == 2 and len(os.listdir(out)) == 3


def test_export_stops_before_pending_work(spark, tmp_path):
    note = export_run.run(spark, str(tmp_path / "book"), str(tmp_path / "out"), tables(spark, ["c"]), at(30), scan=5)
    assert note["traces"] == 2 and not note["again"]
    assert export_run.run(spark, str(tmp_path / "other"), str(tmp_path / "out"), tables(spark), at(30), scan=3)["again"]


def drain(spark, cursor, state, settled, limit=2, most=20):
    """Pages until the reader would wait; state() gives the tables as they are."""
    out = []
    for _ in range(most):
        t, o, f, p = state()
        rows, after, more = evaluator.page(cursor, t, o, f, p, settled, limit)
        out += [(r.trace_id, r.version) for r in rows]
        if after == cursor or (not more and after.phase == cursor.phase):
            return out, after
        cursor = after
    raise AssertionError("no end")


def test_bootstrap_then_live_comes_exactly_once(spark):
    none = spark.createDataFrame([], REF)
    rows, entries = [("a", "u", 1), ("b", "u", 2), ("old", "u", 0)], [("a", 1, 10), ("b", 2, 11)]
    state = lambda: (traces(spark, *rows), observations(spark), feed(spark, *entries), none)
    cursor = evaluator.start(state()[2], at(40), timedelta(minutes=15))
    assert cursor.phase == "bootstrap" and cursor.through == at(55)
    got, more = evaluator.page(cursor, *state(), at(40), 2)[:2]
    rows += [("new", "u", 3), ("a", "u", 45)]  # published while the bootstrap runs
    entries[:] = [("b", 2, 11), ("new", 3, 12), ("a", 45, 13)]
    rest, cursor = drain(spark, more, state, at(60))
    assert [r.trace_id for r in got] == ["old", "a"] and rest == [("b", at(2)), ("new", at(3)), ("a", at(45))]
    assert cursor.phase == "live" and drain(spark, cursor, state, at(60)) == ([], cursor)


def test_bootstrap_waits_for_what_was_active_at_its_start(spark):
    none = spark.createDataFrame([], REF)
    state = lambda: (traces(spark, ("a", "u", 1), ("b", "u", 50)), observations(spark), feed(spark, ("a", 1, 10), ("b", 50, 51)), none)
    cursor = evaluator.start(state()[2], at(40), timedelta(minutes=15))
    got, cursor = drain(spark, cursor, state, at(40))
    assert got == [("a", at(1))] and cursor.phase == "bootstrap"
    got, cursor = drain(spark, cursor, state, at(56))
    assert got == [("b", at(50))] and cursor.phase == "live"


def test_readers_stop_before_pending_work(spark):
    pending = spark.createDataFrame([("p", "b")], REF)
    t, o, f = traces(spark, ("a", "u", 1), ("b", "u", 2), ("c", "u", 3)), observations(spark), feed(spark, ("a", 1, 10), ("b", 2, 11), ("c", 3, 12))
    for cursor in (evaluator.start(f, at(40), timedelta()), evaluator.Cursor("live")):
        rows, after, more = evaluator.page(cursor, t, o, f, pending, at(40), 5)
        assert [r.trace_id for r in rows] == ["a"]
        assert evaluator.page(after, t, o, f, pending, at(40), 5) == ([], after, False)


def test_exact_versions(spark):
    none = spark.createDataFrame([], REF)
    before = (traces(spark, ("a", "u", 1)), observations(spark, ("o", "a", 2)), feed(spark, ("a", 2, 10)), none)
    after = (before[0], observations(spark, ("o", "a", 2), ("new", "a", 5)), before[2], none)
    still = lambda *_: before
    got = evaluator.exact(still, "p", "a", at(2), at(30))
    assert (got["status"], got["trace"].id, [o.id for o in got["observations"]]) == ("ok", "a", ["o"])
    assert evaluator.exact(still, "p", "a", at(1), at(30))["status"] == "conflict"
    assert evaluator.exact(still, "p", "a", at(2), at(1))["status"] == "conflict"  # not settled
    assert evaluator.exact(lambda *_: (traces(spark), observations(spark), feed(spark), none), "p", "a", at(2), at(30))["status"] == "not_found"
    assert evaluator.exact(lambda *_: (*before[:3], spark.createDataFrame([("p", "a")], REF)), "p", "a", at(2), at(30))["status"] == "conflict"
    calls = iter((before, after))
    assert evaluator.exact(lambda *_: next(calls), "p", "a", at(2), at(30))["status"] == "conflict"  # written in between


FACTS = "key_is_ours boolean, is_due boolean, is_pending boolean, is_failed boolean, refs_complete boolean, has_live_trace boolean, has_intent boolean"
FREE = (True, True, False, False, True, False, False)


def candidates(spark, *keys):
    return spark.createDataFrame([("p", k, 4, [f"t-{k}"], *FREE) for k in keys], f"project_id string, object_key string, size long, trace_ids array<string>, {FACTS}")


def raw_store(spark, tmp_path, *keys):
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "raw").mkdir()
    for k in keys:
        (tmp_path / "raw" / k).write_text("body")
    spark.createDataFrame([("p", f"t-{k}", k, at(0), at(0), 1) for k in keys], REFS.replace("tinyint", "int")).withColumn("applied", F.col("applied").cast("tinyint")).write.mode("append").parquet(store.at("raw_event_refs"))
    return store


def now_facts(spark, tmp_path, **changed):
    def facts(intents):
        rows = []
        for r in intents.collect():
            path = tmp_path / "raw" / r.object_key
            told = dict(zip(("key_is_ours", "is_due", "is_pending", "is_failed", "refs_complete", "has_live_trace", "has_intent"), FREE)) | changed.get(r.object_key, {})
            rows.append((r.intent_id, r.size, path.stat().st_size if path.exists() else None, *told.values()))
        return spark.createDataFrame(rows, f"intent_id string, size long, size_now long, {FACTS}")

    return facts


def test_expiry_of_raw_objects(spark, tmp_path):
    store = raw_store(spark, tmp_path, "k1", "k2", "k3")
    book = retention_log.log(store)
    vetoed = candidates(spark, "k9").withColumn("is_pending", F.lit(True))
    assert retention_log.prepare(book, candidates(spark, "k1", "k2").unionByName(vetoed), T0) == 2
    assert retention_log.prepare(book, candidates(spark, "k1", "k2", "k3"), T0, most_objects=9, most_bytes=4) == 1  # one intent an object
    ids = {r.object_key: r.intent_id for r in book.read().collect()}
    (tmp_path / "raw/k3").write_text("changed")
    got = retention_log.execute(store, sorted(ids.values()), now_facts(spark, tmp_path, k2={"has_live_trace": True}), str(tmp_path / "raw"), at(1))
    assert {k: got[i] for k, i in ids.items()} == {"k1": "done", "k2": "trace_retained", "k3": "object_changed"}
    assert sorted(os.listdir(tmp_path / "raw")) == ["k2", "k3"]
    assert [(r.state, r.attempts, r.last_error) for r in book.read().orderBy("object_key").collect()] == [("done", 0, None), ("prepared", 1, "trace_retained"), ("prepared", 1, "object_changed")]
    assert [r.trace_id for r in retention_log.markers(store).collect()] == ["t-k1"]
    assert [r.object_key for r in refs.expired(store.read("raw_event_refs", REFS)).collect()] == ["k1"] == [r.object_key for r in retention_log.fenced(book).collect()]
    assert retention_log.execute(store, [ids["k1"]], now_facts(spark, tmp_path), str(tmp_path / "raw"), at(2)) == {ids["k1"]: "already_done"}
    with pytest.raises(ValueError):
        retention_log.execute(store, ["unknown"], now_facts(spark, tmp_path), str(tmp_path / "raw"), at(2))


@pytest.mark.parametrize("step", range(5))
def test_expiry_that_dies_ends_the_same(spark, tmp_path, monkeypatch, step):
    """Dies before the fence, before the deletion is noted, before the object goes, before the markers, before the end."""
    store = raw_store(spark, tmp_path, "k1")
    book = retention_log.log(store)
    retention_log.prepare(book, candidates(spark, "k1"), T0)
    (i,) = [r.intent_id for r in book.read().collect()]
    move, left = retention_log._move, [(0,), (2,), None, None, (3,)][step]
    calls = []

    def dying(*a, **b):
        calls.append(1)
        if left and len(calls) - 1 == left[0]:
            raise RuntimeError("died")
        return move(*a, **b)

    with monkeypatch.context() as m:
        m.setattr(retention_log, "_move", dying)
        if step == 2:
            m.setattr(type(store.files), "delete", lambda self, path: (_ for _ in ()).throw(RuntimeError("died")) if path.endswith("k1") else True)
        if step == 3:
            m.setattr(retention_log, "_expire", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            retention_log.execute(store, [i], now_facts(spark, tmp_path), str(tmp_path / "raw"), at(1))
    assert retention_log.execute(store, [i], now_facts(spark, tmp_path), str(tmp_path / "raw"), at(2)) == {i: "done"}
    assert os.listdir(tmp_path / "raw") == [] and store.read("raw_trace_retention", retention_log.MARKERS).count() == 1
    assert store.read("raw_event_refs", REFS).where("applied = 2").count() == 1 and book.read().first().state == "done"


def test_diagnostics_go_whole_or_not_at_all(spark):
    failures = spark.createDataFrame([("p", k, e, at(m)) for k, e, m in (("whole", "e1", 0), ("whole", "e2", 0), ("bare", "e1", 0), ("broken", "e1", 0), ("part", "e1", 0), ("fresh", "e1", 90))], "project_id string, object_key string, event_id string, created_at timestamp")
    sidecars = spark.createDataFrame([("p", k, b) for k, b in (("whole", '{"events":["e2","e1"]}'), ("broken", "{"), ("part", '{"events":["e1","e2"]}'), ("fresh", '{"events":["e1"]}'))], "project_id string, object_key string, body string")
    got = {r.object_key: r.action for r in retention_log.diagnostics(failures, sidecars, at(60)).collect()}
    assert got == {"whole": "delete", "bare": "sidecar_missing", "broken": "sidecar_invalid", "part": "sets_differ", "fresh": "inside_window"}
    assert {r.action for r in retention_log.diagnostics(failures, sidecars, at(60), most=0).where("object_key = 'whole'").collect()} == {"row_cap"}


def test_retention_pass(spark, tmp_path):
    store, now = Store(spark, str(tmp_path / "store"), buckets=2), datetime(2024, 6, 1)
    days = {"old": 400, "due": 40, "held": 40, "new": 3}  # projects keep 30 days, p2 keeps 365
    day = lambda n: now - timedelta(days=n)
    rows = [{"id": i, "timestamp": day(d), "event_ts": day(d), "project_id": "p2" if i == "held" else "p"} for i, d in days.items()]
    store.append("traces", table(spark, "traces", rows))
    kids = [("o1", "old", 400), ("o2", "due", 39), ("o3", "held", 39), ("o4", "new", 50), ("o5", "due", 2)]
    store.append("observations", table(spark, "observations", [{"id": i, "trace_id": t, "start_time": day(d), "event_ts": day(d), "project_id": "p2" if t == "held" else "p"} for i, t, d in kids]))
    store.append("trace_feed", spark.createDataFrame([("p2" if i == "held" else "p", i, "a", day(d), day(d)) for i, d in days.items()], FEED))
    projects = spark.createDataFrame([("p", 30), ("p2", 365)], "project_id string, retention_days int")
    done = retention_pass.run_pass(store, projects, now, 90)
    left = lambda kind: sorted(r.id for r in retention_pass.live(store, kind).collect())
    assert left("traces") == ["held", "new"] and left("observations") == ["o3", "o4"]  # o4 is old, but its trace stays; o5 is new, but its trace went
    assert (done["traces_months"], done["observations_months"], done["traces"], done["orphan_observations"]) == (1, 1, 1, 1)
    assert "2023-04" not in store.months("traces") and sorted(r.trace_id for r in store.read("trace_feed").collect()) == ["held", "new"]
    assert sorted(r.trace_id for r in retention_pass.expired_parents(store).collect()) == ["due", "old"]
    again = retention_pass.run_pass(store, projects, now, 90)
    assert set(again.values()) == {0} and left("traces") == ["held", "new"] and store.files.listed(store.at("_staged")) == []
