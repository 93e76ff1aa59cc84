"""Keyed states, paging cursors and the functions that no catalogue query covers."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanloom.functions import pricing, text
from spanloom.functions import time as T
from spanloom.operators import environments, filters, moved, paging, settlement, state, tree
from spanloom.sources import export

NOW = datetime(2024, 1, 2, 12)


def test_receipts(spark):
    known = spark.createDataFrame([("p", "a", "x")], "project_id string, receipt_id string, fingerprint string")
    sent = spark.createDataFrame([("p", "a", "x", 0), ("p", "a", "y", 1), ("p", "b", "z", 2), ("p", "b", "z", 3), ("p", "b", "q", 4)], "project_id string, receipt_id string, fingerprint string, ordinal int")
    got = {r.ordinal: r.outcome for r in state.receipts(known, sent).collect()}
    assert got == {0: "replay", 1: "conflict", 2: "new", 3: "replay", 4: "conflict"}


def test_claims(spark):
    at = lambda h, m=0: datetime(2024, 1, 2, h, m)
    kind = "project_id string, webhook_id string, trace_id string, version timestamp"
    deliveries = spark.createDataFrame([("p", "w", t, v, s, c) for t, v, s, c in (("done", at(1), "delivered", at(2)), ("covered", at(9), "delivered", at(10)), ("busy", at(1), "pending", at(11, 55)), ("stale", at(1), "pending", at(11, 40)), ("failed", at(1), "failed", at(11, 59)))], f"{kind}, state string, claimed_at timestamp")
    wanted = spark.createDataFrame([("p", "w", t, at(1)) for t in ("done", "covered", "busy", "stale", "failed", "fresh")], kind)
    got = {r.trace_id: r.claim for r in state.claims(deliveries, wanted, NOW).collect()}
    assert got == {"done": "done", "covered": "covered", "busy": "busy", "stale": "taken", "failed": "taken", "fresh": "taken"}


def test_snapshots_and_cursors(spark):
    kind = "project_id string, trace_id string, content_hash string"
    staged = spark.createDataFrame([("p", "a", "x", NOW), ("p", "b", "x", datetime(2030, 1, 1))], f"{kind}, version timestamp")
    pulled = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("p", "c", "z")], kind)
    got = {r.trace_id: (r.version, r.changed) for r in state.stage_snapshots(staged, pulled, NOW).collect()}
    assert got == {"a": (NOW, False), "b": (datetime(2030, 1, 1, 0, 0, 0, 1000), True), "c": (NOW, True)}
    assert state.move_cursor({"a": 1}, {"a": 1}, {"a": 2}) == ({"a": 2}, True) and state.move_cursor({"a": 3}, {"a": 1}, {"a": 2}) == ({"a": 3}, False)
    one = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "a")], "key string, n int, s string")
    a, b = (dict(export.content_hash(d, ["key"]).collect()) for d in (one, one.orderBy(F.desc("n"))))
    assert a == b and a["k"] != a["j"]


def test_recovery_and_vetoes(spark):
    snapshots = spark.createDataFrame([("p", r, "pending", ts) for r, ts in (("alive", NOW), ("lost", NOW), ("lost", datetime(2020, 1, 1)))] + [("p", "lost", "done", NOW)], "project_id string, run_id string, status string, timestamp timestamp")
    runs = spark.createDataFrame([("alive", datetime(2024, 1, 2, 11, 58)), ("lost", datetime(2024, 1, 2, 11, 50))], "run_id string, leased_at timestamp")
    cutoffs = spark.createDataFrame([("p", datetime(2023, 1, 1))], "project_id string, cutoff timestamp")
    assert sorted(r.action for r in state.settle_pending(snapshots, runs, cutoffs, NOW).collect()) == ["discard", "publish", "wait"]
    keys = lambda *k: spark.createDataFrame([("p", x) for x in k], "project_id string, object_key string")
    got = {r.object_key: r.action for r in state.after_failure(keys("a", "b", "c"), keys("a", "a"), keys("a", "b")).collect()}
    assert got == {"a": "apply", "b": "retry", "c": "quarantine"}
    facts = "key_is_ours is_due is_pending is_failed refs_complete has_live_trace has_intent".split()
    rows = [(1, True, True, False, False, True, False, False), (2, True, True, True, True, True, False, False), (3, True, True, False, False, None, False, False)]
    got = {r.n: r.reason for r in state.expiry_vetoes(spark.createDataFrame(rows, "n int, " + ", ".join(f"{f} boolean" for f in facts))).collect()}
    assert got == {1: None, 2: "pending", 3: "references_truncated"}
    assert state.new_intents(keys("a"), keys("a", "b", "b")).count() == 1


def test_cursors_and_parameters():
    cursor = paging.encode_cursor({"timestamp": "2024-01-01T00:00:00Z", "id": "é"})
    assert paging.decode_cursor(cursor, ("timestamp", "id")) == {"timestamp": "2024-01-01T00:00:00Z", "id": "é"}
    assert paging.decode_cursor(cursor, ("id",)) is None and paging.decode_cursor("!!", ("id",)) is None
    f = filters.TraceFilter.from_params({"user_id": " ", "model": " m ", "tags": "a, ,b", "min_cost": "0.8", "metadata_key": "k", "metadata_value": ""})
    assert (f.user_id, f.model, f.tags, f.min_cost, f.metadata) == (None, "m", ("a", "b"), Decimal("0.8"), None)
    bad = ({"search": "x" * 201}, {"model": "\U0001f600" * 101}, {"min_cost": "-1"}, {"min_cost": "NaN"}, {"min_cost": "x"}, {"min_cost": "1e13"}, {"min_duration_ms": str(2**53)}, {"min_duration_ms": "1.5"}, {"level": "loud"}, {"environment": "x" * 65}, {"environment": "a\u200bb"})
    for params in bad:
        with pytest.raises(ValueError):
            filters.TraceFilter.from_params(params)
    f = filters.TraceFilter.from_params({"user_id": "u" * 300, "session_id": " s", "min_duration_ms": " 1e3 ", "min_cost": " ", "level": "error", "environment": " e\u0301 "})
    assert (len(f.user_id), f.session_id, f.min_duration_ms, f.min_cost, f.level, f.environment) == (300, " s", 1000, None, "error", "\u00e9")
    assert [filters.page_limit(p) for p in ({}, {"limit": "1"}, {"limit": "100"})] == [20, 1, 100]
    for asked in ("0", "101", "-1", "2.5", "", "x"):
        with pytest.raises(ValueError):
            filters.page_limit({"limit": asked})


def test_publication_clock_rises(spark):
    rows = spark.createDataFrame([("p", "1", "a", NOW), ("p", "1", "b", NOW), ("p", "2", "c", datetime(2024, 1, 1)), ("q", "1", "a", NOW)], "project_id string, activity_id string, trace_id string, received_at timestamp")
    got = settlement.publication_clock(rows, F.lit(datetime(2024, 1, 2, 13)).cast("timestamp")).orderBy("project_id", "published_at").collect()
    times = [r.published_at for r in got if r.project_id == "p"]
    assert times == sorted(set(times)) and min(times) > datetime(2024, 1, 2, 13) and [r.trace_id for r in got[:3]] == ["a", "b", "c"]


def test_same_batch_rows_and_other_days(spark):
    kind = "kind string, project_id string, trace_id string, id string, sort_time timestamp"
    day = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([("trace", "p", "", "a", day(1), 0), ("trace", "p", "", "a", day(2), 1), ("trace", "p", "", "b", day(1), 2)], f"{kind}, ordinal int")
    stored = spark.createDataFrame([("trace", "p", "", "a", day(1), day(3)), ("trace", "p", "", "a", day(2), day(3)), ("trace", "p", "", "b", day(1), day(9)), ("trace", "p", "", "b", day(2), day(3))], f"{kind}, event_ts timestamp")
    write, gone = moved.resolve(rows, stored, day(5))
    assert [(r.id, r.sort_time) for r in write.collect()] == [("a", day(2))]
    assert sorted((r.id, r.sort_time) for r in gone.collect()) == [("a", day(1)), ("b", day(2))]


def test_registry_and_prices(spark, tmp_path):
    registry = spark.createDataFrame([("p", "a", NOW, NOW, False)], "project_id string, name string, first_seen_at timestamp, last_seen_at timestamp, hidden boolean")
    assert environments.set_hidden(registry, "p", "a", True).first().hidden and not environments.set_hidden(registry, "p", "b", True).first().hidden
    (tmp_path / "prices.json").write_text(json.dumps({"syncedAt": "d", "models": {"m": {"provider": "x", "input": 0.000003, "output": 0.000015, "cache_read": 0.0000003}}}))
    prices = pricing.read_prices(spark, str(tmp_path / "prices.json"))
    usage = spark.createDataFrame([("p", "M-20240101", {"input_tokens": Decimal(1000), "output_tokens": Decimal(200), "cache_read_input_tokens": Decimal(5000)}, None, {})], "project_id string, model string, usage_details map<string,decimal(20,0)>, cost_details map<string,decimal(18,9)>, metadata map<string,string>")
    none = spark.createDataFrame([], "project_id string, position int, pattern string, input decimal(24,15), output decimal(24,15), cache_read decimal(24,15), cache_write decimal(24,15)")
    (r,) = pricing.enrich(usage, none, prices).collect()
    assert r.cost_details["total"] == Decimal("0.0075") and r.metadata[pricing.PROVENANCE[0]] == "table"
    rules = spark.createDataFrame([("b", 1, None, None, None, None), ("a", 0, None, None, None, None)], "pattern string, ordinal int, input decimal(24,15), output decimal(24,15), cache_read decimal(24,15), cache_write decimal(24,15)")
    assert [(x.position, x.pattern) for x in state.replace_overrides(none, "p", rules).orderBy("position").collect()] == [(0, "a"), (1, "b")]


def test_presets():
    assert T.preset_from(NOW, "all") is None and T.preset_from(NOW, "24h") == datetime(2024, 1, 1, 12)


def test_tree_response(spark, sf_dir):
    from spanloom.plans import projections as P

    traces, observations = P.conv_traces(spark, sf_dir), P.conv_observations(spark, sf_dir)
    made = {r.id: json.loads(r.body) for r in export.tree_response(traces, tree.observation_tree(observations), observations).collect()}
    counts = {r.trace_id: r["count"] for r in observations.groupBy("trace_id").count().collect()}
    for i, body in made.items():
        n, node = 0, body["observations"]
        while node:
            assert len(node) == 1
            n, node = n + 1, node[0]["children"]
        assert n == counts[i]


def test_raw_slice(spark):
    index = spark.createDataFrame([("p", "t", f"o{i}", datetime(2024, 1, i + 1)) for i in range(3)], "project_id string, trace_id string, object_key string, received_at timestamp")
    events = spark.createDataFrame([("p", "o0", "e0", "trace-upsert", "native", '{"id":"t"}'), ("p", "o0", "e1", "trace-upsert", "native", '{"id":"u"}'), ("p", "o1", "e2", "otlp-export", "otlp", '{"x":"t"}'), ("p", "o1", "e4", "otlp-export", "otlp", '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"u"},{"traceId":"t"}]}]}]}'), ("p", "o1", "e5", "otlp-export", "otlp", '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"u"}]}]}]}'), ("p", "o1", "e6", "langfuse-ingestion", "langfuse", '{"batch":[{"type":"span-update","body":{"id":"o"}}]}'), ("p", "o1", "e7", "langfuse-ingestion", "langfuse", '{"batch":[{"type":"trace-create","body":{"id":"t"}}]}'), ("p", "o1", "e8", "langfuse-ingestion", "langfuse", '{"batch":[{"type":"trace-create","body":{"id":"u"}}]}'), ("p", "o2", "e3", "otlp-export", "otlp", '{"x":"t"}')], "project_id string, object_key string, id string, type string, source string, body string").withColumn("received_at", F.lit(NOW))
    got = {(r.object_key, r.event_id, r.match, r.truncated) for r in export.raw_slice(index, events, 2, 1000).collect()}
    assert got == {("o0", "e0", "EXACT", None), ("o1", "e2", "POSSIBLE", None), ("o1", "e4", "EXACT", None), ("o1", "e6", "POSSIBLE", None), ("o1", "e7", "EXACT", None), ("o2", None, None, "object_limit")}


def test_export_batches_follow_the_feed(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    feed = spark.createDataFrame([(at(1), "a", "emit"), (at(2), "b", "step_over"), (at(3), "c", "emit"), (at(4), "d", "blocked"), (at(5), "e", "emit")], "published_at timestamp, trace_id string, status string")
    rows, cursor = settlement.next_batch(feed, None, 2)
    assert [r.trace_id for r in rows] == ["a"] and cursor == (at(2), "b")
    rows, cursor = settlement.next_batch(feed, cursor, 10)
    assert [r.trace_id for r in rows] == ["c"] and cursor == (at(3), "c")
    assert settlement.next_batch(feed, cursor, 10) == ([], cursor)


def test_pulled_pages(spark, tmp_path):
    from spanloom.sources import importers

    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"id": f"s{i}", "traceId": "t", "name": "n", "value": i, "source": "EVAL"}, {"id": "none", "traceId": "t", "name": "n"}], "meta": {"page": i}}))
    row = "id:string,traceId:string,observationId:string,name:string,dataType:string,value:double,stringValue:string,source:string,comment:string,timestamp:string"
    got = importers.map_list_scores(importers.read_pulled(spark, str(tmp_path), row), "p").orderBy("id").collect()
    assert [(r.id, r.value, r.data_type, r.source) for r in got] == [("s0", 0.0, "numeric", "eval"), ("s1", 1.0, "numeric", "eval")]
