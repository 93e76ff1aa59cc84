"""Mappers and the streaming ingest, over small landed files."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanloom.operators import moved, tree, versions
from spanloom.sources import compat, export, importers, native, otlp, raw
from spanloom.streaming import ingest

AT = "2024-05-01T10:00:00.000Z"


def land(path, batch, events, project="p1", at=AT):
    full = [{"schemaVersion": 1, "idempotencyKey": e["id"], **e, "body": json.dumps(e["body"]) if not isinstance(e["body"], str) else e["body"]} for e in events]
    folder = path / "raw" / project / at[:10].replace("-", "/")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{batch}.json").write_text(json.dumps({"batchId": batch, "projectId": project, "receivedAt": at, "events": full}))


def event(i, kind, source, body):
    return {"id": f"e{i}", "type": kind, "source": source, "body": body}


def read(spark, path):
    return raw.read_batches(spark, f"{path}/raw/*/*/*/*/*.json")


NATIVE = [
    event(1, "trace-upsert", "native", {"id": " t1 ", "timestamp": "2024-05-01T09:00:00Z", "name": "n", "environment": "a\u0007", "tags": ["x"], "input": {"q": 1}, "output": None}),
    event(2, "observation-upsert", "native", {"id": "o1", "traceId": "t1", "type": "generation", "startTime": "2024-05-01T09:00:00Z", "endTime": "2024-05-01T09:00:01.500Z", "model": "m", "usageDetails": {"input": 9, "input_tokens": 12, "completionTokens": 3}, "costDetails": {"total": 2.5}}),
    event(3, "score-upsert", "native", {"id": "s1", "traceId": "t1", "name": "good", "source": "api", "value": 0}),
    event(4, "score-upsert", "native", {"id": "s2", "traceId": "t1", "name": "none", "source": "api"}),
    event(5, "observation-upsert", "native", {"id": "o2", "traceId": "t1", "type": "what", "startTime": "2024-05-01T09:00:00Z"}),
    event(6, "trace-upsert", "native", "not json"),
    event(7, "observation-upsert", "native", {"id": "o3", "traceId": "t1", "type": "span", "startTime": "2024-05-01T09:00:00Z", "usageDetails": {"input": 1.5}}),
]


def test_native_events(spark, tmp_path):
    land(tmp_path, "b1", NATIVE)
    (tmp_path / "raw/p1/2024/05/01/bad.json").write_text("{")
    batches = read(spark, tmp_path)
    events = raw.events(batches)
    assert events.count() == 7 and raw.bad_batches(batches).count() == 1
    t = native.traces(events).collect()
    assert [(r.id, r.environment, r.tags, r.input, r.output) for r in t] == [("t1", None, ["x"], '{"q":1}', "null")]
    o = native.observations(events).collect()
    assert [(r.id, r.level, {k: int(v) for k, v in r.usage_details.items()}, r.cost_details["total"]) for r in o] == [("o1", "default", {"input_tokens": 12, "output_tokens": 3}, Decimal("2.5"))]
    s = native.scores(events).collect()
    assert [(r.id, r.value, r.data_type, str(r.timestamp)) for r in s] == [("s1", 0.0, "numeric", "2024-05-01 10:00:00")]
    assert {r.event_id: r.message for r in native.errors(events).collect()} == {"e4": "score requires value or stringValue", "e5": "type is unknown", "e6": "body is no object", "e7": "usageDetails holds no counts"}
    told = {r.id: r.c for r in events.select("id", raw.concerns(F.lit("t1")).alias("c")).collect()}
    assert told["e2"] == "EXACT" and told["e6"] == "NO" and told["e1"] == "NO"  # ids are compared as sent


def attribute(key, **value):
    return {"key": key, "value": value}


OTLP = {
    "resourceSpans": [{
        "resource": {"attributes": [attribute("deployment.environment.name", stringValue=" prod "), attribute("service.version", stringValue="1.2"), attribute("session.id", stringValue="s9")]},
        "scopeSpans": [{"spans": [
            {"traceId": "t", "spanId": "root", "name": "r", "startTimeUnixNano": "1714554000123999999", "endTimeUnixNano": "1714554001000000000", "attributes": [attribute("user.id", stringValue="u"), attribute("x", intValue="1"), attribute("x", boolValue=True)]},
            {"traceId": "t", "spanId": "kid", "parentSpanId": "root", "name": "k", "startTimeUnixNano": "1714554000500000000", "status": {"code": 2, "message": "bad"}, "attributes": [
                attribute("gen_ai.response.model", stringValue="m"), attribute("gen_ai.system", stringValue="old"), attribute("gen_ai.usage.input_tokens", intValue="120"), attribute("gen_ai.usage.output_tokens", doubleValue=339.5), attribute("gen_ai.usage.cost", doubleValue=-1.0),
                attribute("gen_ai.usage.cache_write.input_tokens", intValue="5"), attribute("gen_ai.request.temperature", doubleValue=0.5), attribute("gen_ai.input.messages", stringValue='[{"role":"user","parts":[{"type":"text","content":"hi"}]}]'), attribute("gen_ai.output.messages", stringValue='[{"role":"assistant","parts":[]}]')]},
            {"traceId": "t", "spanId": "second", "name": "other root", "startTimeUnixNano": "1714554000500000000"},
        ]}],
    }]
}


def test_otlp_export(spark, tmp_path):
    land(tmp_path, "b1", [event(1, "otlp-export", "otlp", OTLP)])
    spans = otlp.spans(raw.events(read(spark, tmp_path)))
    (t,) = otlp.traces(spans).collect()
    assert (t.id, t.name, t.environment, t.session_id, t.user_id, t.release, t.timestamp.microsecond) == ("t", "r", "prod", "s9", "u", "1.2", 123000)
    o = {r.id: r for r in otlp.observations(spans).collect()}
    assert (o["root"].type, o["kid"].type, o["kid"].level, o["kid"].status_message, o["kid"].model) == ("span", "generation", "error", "bad", "m")
    assert {k: int(v) for k, v in o["kid"].usage_details.items()} == {"input_tokens": 120, "output_tokens": 340, "cache_creation_input_tokens": 5}
    assert o["kid"].cost_details is None and o["kid"].metadata["gen_ai.provider.name"] == "old" and o["root"].metadata["x"] == "true"
    assert o["kid"].model_parameters == {"temperature": "0.5"} and o["kid"].input == '[{"role":"user","parts":[{"type":"text","content":"hi"}]}]' and o["kid"].output is None
    assert otlp.unmapped(spans).count() == 0


def compat_batch(*events):
    return event(1, "langfuse-ingestion", "langfuse", {"batch": [{"id": f"x{i}", "timestamp": "2024-05-01T09:30:00Z", "type": t, "body": json.dumps(b)} for i, (t, b) in enumerate(events)]})


CREATE = ("generation-create", {"id": "g1", "traceId": "t1", "model": "m", "input": {"a": 1}, "usage": {"promptTokens": 3, "completionTokens": 4.5, "bad": -1}, "level": "WARNING"})
UPDATE = ("generation-update", {"id": " g1 ", "endTime": "2024-05-01T09:40:00Z", "model": None, "output": "done"})


@pytest.mark.parametrize("order", [(CREATE, UPDATE), (UPDATE, CREATE)])
def test_create_and_update_merge_in_any_order(spark, tmp_path, order):
    land(tmp_path, "b1", [compat_batch(*order, ("span-create", {"id": "s1"}), ("sdk-log", {}), ("trace-create", {"id": "t1", "tags": ["a"], "metadata": {"k": {"n": 1}}}), ("score-create", {"traceId": "t1", "name": "ok", "value": 0}), ("score-create", {"traceId": "t1", "name": "none"}), ("what", {}))])
    rows = compat.events(raw.events(read(spark, tmp_path)))
    (o,) = compat.observations(rows).collect()
    assert (o.trace_id, o.model, o.input, o.output, o.level, o.type, o.end_time.minute) == ("t1", "m", '{"a":1}', '"done"', "warning", "generation", 40)
    assert {k: int(v) for k, v in o.usage_details.items()} == {"input_tokens": 3, "output_tokens": 5}
    assert {"model", "end_time", "type", "usage_details"} <= set(o.provided) and "start_time" not in o.provided
    (t,) = compat.traces(rows).collect()
    assert (t.metadata, t.tags, t.timestamp.minute, sorted(t.provided)) == ({"k": '{"n":1}'}, ["a"], 30, ["metadata", "tags"])
    (s,) = compat.scores(rows).collect()
    assert (s.value, s.data_type, len(s.id)) == (0.0, "numeric", 35)
    codes = {r.event_id: r.status for r in compat.responses(rows).collect()}
    assert codes == {"x0": 201, "x1": 201, "x2": 400, "x3": 201, "x4": 201, "x5": 201, "x6": 400, "x7": 400}


def test_stream_replay_and_moved_rows(spark, tmp_path):
    landing, store = tmp_path / "land", ingest.Store(spark, str(tmp_path / "store"))
    land(landing, "b1", NATIVE[:4])
    ingest.start(store, f"{landing}/raw", str(tmp_path / "ck")).awaitTermination()
    live = lambda kind: versions.latest(store.read(kind), kind)
    assert [live(k).count() for k in ("traces", "observations", "scores")] == [1, 1, 1]
    again = {**NATIVE[1]["body"], "startTime": "2024-05-03T09:00:00Z", "endTime": "2024-05-03T09:00:09Z", "model": "m2"}
    land(landing, "b2", [event(9, "observation-upsert", "native", again)], at="2024-05-01T11:00:00.000Z")
    ingest.start(store, f"{landing}/raw", str(tmp_path / "ck")).awaitTermination()
    ingest.start(store, f"{landing}/raw", str(tmp_path / "ck2")).awaitTermination()  # everything once more
    (o,) = live("observations").collect()
    assert (o.model, o.start_time.day) == ("m2", 3)
    feed = {r.trace_id: str(r.version) for r in ingest.current_feed(store).collect()}
    assert feed == {"t1": "2024-05-01 11:00:00"}
    assert ingest.unfinished(store).count() == 0
    assert store.read("ingest_failures", ingest.FAILED).select("event_id").distinct().count() == 1


def run(spark, store, landing, checkpoint):
    ingest.start(store, f"{landing}/raw", str(checkpoint)).awaitTermination()


def test_updates_meet_rows_of_earlier_batches(spark, tmp_path):
    landing, store = tmp_path / "land", ingest.Store(spark, str(tmp_path / "store"))
    live = lambda kind: versions.latest(store.read(kind), kind).collect()
    started = ("generation-create", {**CREATE[1], "startTime": "2024-05-01T09:00:00Z"})
    land(landing, "b1", [compat_batch(started)])
    run(spark, store, landing, tmp_path / "ck")
    land(landing, "b2", [compat_batch((UPDATE[0], {**UPDATE[1], "traceId": "t1"}))], at="2024-05-01T11:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    (o,) = live("observations")
    assert (o.model, o.input, o.output, o.start_time.hour, o.end_time.minute, o.level, str(o.event_ts)) == ("m", '{"a":1}', '"done"', 9, 40, "warning", "2024-05-01 11:00:00")
    # received before both, read after both: only what neither says comes in, and the version stays
    land(landing, "b0", [compat_batch(("generation-update", {"id": "g1", "traceId": "t1", "model": "old", "name": "late"}))], at="2024-05-01T08:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    (o,) = live("observations")
    assert (o.model, o.name, o.output, str(o.event_ts)) == ("m", "late", '"done"', "2024-05-01 11:00:00")
    run(spark, store, landing, tmp_path / "all")  # everything once more, in one micro-batch
    assert [(r.model, r.name, r.input, r.output, str(r.event_ts)) for r in live("observations")] == [("m", "late", '{"a":1}', '"done"', "2024-05-01 11:00:00")]


def test_creates_after_updates_on_another_day(spark, tmp_path):
    landing, store = tmp_path / "land", ingest.Store(spark, str(tmp_path / "store"))
    update = ("generation-update", {"id": "g1", "traceId": "t1", "output": "done"})  # has no start: the event's time stands in
    land(landing, "b2", [compat_batch(update)], at="2024-05-03T11:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    land(landing, "b1", [compat_batch(("generation-create", {**CREATE[1], "startTime": "2024-04-30T09:00:00Z"}))])
    run(spark, store, landing, tmp_path / "ck")
    (o,) = versions.latest(store.read("observations"), "observations").collect()
    assert (o.model, o.output, o.start_time.day, str(o.event_ts)) == ("m", '"done"', 30, "2024-05-03 11:00:00")


def test_late_rows_failures_and_score_feed(spark, tmp_path):
    landing, store = tmp_path / "land", ingest.Store(spark, str(tmp_path / "store"))
    trace = lambda day, name: event(1, "trace-upsert", "native", {"id": "t9", "timestamp": f"2024-05-0{day}T09:00:00Z", "name": name})
    land(landing, "b1", [trace(3, "new")], at="2024-05-03T12:00:00.000Z")
    run(spark, store, landing, tmp_path / "ck")
    broken = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "x", "spanId": "a", "name": "n", "startTimeUnixNano": "soon"}, {"traceId": "x", "spanId": "b", "name": "n", "startTimeUnixNano": "1714554000500000000"}]}]}]}
    score = event(4, "score-upsert", "native", {"id": "s1", "traceId": "t9", "name": "good", "source": "api", "value": 1})
    land(landing, "b2", [trace(1, "late"), event(2, "otlp-export", "otlp", broken), {**compat_batch(("what", {})), "id": "e3"}], at="2024-05-03T10:00:00.000Z")
    land(landing, "b3", [score], at="2024-05-03T10:00:00.000Z")  # the same time, another batch
    run(spark, store, landing, tmp_path / "ck")
    assert [(r.name, r.timestamp.day) for r in versions.latest(store.read("traces"), "traces").collect()] == [("new", 3)]
    assert store.read("observations").count() == 0
    assert {(r.event_id, r.event_type, r.source) for r in store.read("ingest_failures", ingest.FAILED).collect()} == {("e2", "otlp-export", "otlp"), ("x0", "langfuse-ingestion", "langfuse")}
    (trace,), (scores,) = ingest.current_feed(store).collect(), ingest.current_score_feed(store).collect()
    assert (trace.trace_id, trace.activity_id, scores.trace_id) == ("t9", "b2", "t9")
    assert scores.published_at > trace.published_at > datetime.now() - timedelta(hours=1)  # of the writing, not of the receipt
    linked = {(r.trace_id, r.object_key.rsplit("/", 1)[1]) for r in store.read("raw_event_refs", ingest.REFS).collect()}
    assert linked == {("t9", "b1.json"), ("t9", "b2.json"), ("t9", "b3.json")} and ingest.unfinished(store).count() == 0


def test_json_lines_map_back(spark, tmp_path):
    land(tmp_path, "b1", NATIVE[:3])
    rows = ingest.mapped(raw.events(read(spark, tmp_path)))
    at = rows["traces"].select("project_id", F.col("id").alias("trace_id"), F.col("event_ts").alias("version"))
    lines = export.json_lines(export.stamped(rows["traces"], at, "id"), export.stamped(rows["observations"], at), export.stamped(rows["scores"], at))
    export.write_json_lines(lines, str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [b["type"] for b in back] == ["trace-upsert", "observation-upsert", "score-upsert"]
    land(tmp_path / "again", "b1", [{k: b[k] for k in ("id", "type", "source", "body")} for b in back])
    second = ingest.mapped(raw.events(read(spark, tmp_path / "again")))
    for kind, drop in (("traces", ["input", "output"]), ("observations", []), ("scores", [])):
        a, b = (d[kind].drop("event_ts", "seq", *drop).collect() for d in (rows, second))
        assert a == b
    export.write_parquet({k: export.stamped(v, at, "id" if k == "traces" else "trace_id") for k, v in rows.items()}, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq/observations")).count() == 1


def test_trees():
    built = {r[0]: r[1:] for r in tree.build([("a", None, 2), ("b", "a", 3), ("c", "a", 1), ("d", "gone", 0), ("x", "y", 5), ("y", "x", 4), ("z", "x", 6), ("s", "s", 9)])}
    assert built["c"][:5] == ("a", 1, 2, False, 0) and built["b"][2] == 3
    assert all(built[i][3] for i in "adxyzs") and built["z"][0] is None and built["a"][5] == 3 and built["c"][5] == 2
    chain = tree.build([(str(i), str(i - 1) if i else None, i) for i in range(2000)])
    assert chain[-1][2] == 1999


def test_recency_merge_keeps_costs_consistent(spark):
    meta = "map<string,string>"
    cost = "map<string,decimal(18,9)>"
    stored = spark.createDataFrame(
        [("a", "old", {"total": Decimal(1)}, {"spanloom:cost_source": "table", "k": "v"}, {"input_tokens": 5}, None, "2024-01-01 00:00:00")],
        f"id string, model string, cost_details {cost}, metadata {meta}, usage_details map<string,int>, sent_at map<string,timestamp>, at string",
    ).withColumn("event_ts", F.to_timestamp("at"))
    incoming = spark.createDataFrame([("a", "new", None, {}, None, ["model"])], f"id string, model string, cost_details {cost}, metadata {meta}, usage_details map<string,int>, provided array<string>")
    fields = ["model", "cost_details", "metadata", "usage_details"]
    for when, model, has_cost in (("2024-02-01 00:00:00", "new", False), ("2023-01-01 00:00:00", "old", True)):
        merged = moved.by_recency(incoming, stored, ["id"], fields, F.to_timestamp(F.lit(when))).join(incoming.select("id", "provided"), "id")
        (r,) = moved.consistent_cost(merged).collect()
        assert (r.model, r.cost_details is not None, r.metadata.get("k"), dict(r.usage_details)) == (model, has_cost, "v", {"input_tokens": 5})
        assert ("spanloom:cost_source" in r.metadata) == has_cost


def test_imports(spark):
    runs = spark.createDataFrame(
        [("r1", "t1", None, "chain", "root", "2024-01-01T00:00:00Z", None, "success", None, None, "{}", None, 3, 4, 7, "0.1", "-1", None, ["a"], None), ("r2", "t1", "r1", "llm", "call", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", "error", "boom", "m", "{}", "{}", None, None, None, None, None, "x", None, "s")],
        "id string, trace_id string, parent_run_id string, run_type string, name string, start_time string, end_time string, status string, error string, model string, inputs string, outputs string, prompt_tokens long, completion_tokens long, total_tokens long, prompt_cost string, completion_cost string, total_cost string, tags array<string>, session_id string",
    )
    traces, observations = importers.map_runs(runs, "p")
    assert traces.first().tags == ["a", "imported:langsmith"]
    o = {r.id: r for r in observations.collect()}
    assert dict(o["r1"].cost_details) == {"input": Decimal("0.1")} and int(o["r1"].usage_details["total_tokens"]) == 7
    assert (o["r2"].type, o["r2"].level, o["r2"].cost_details) == ("generation", "error", None)
    feedback = spark.createDataFrame([("f1", "r1", "k", 1.0, None, None, None), ("f2", "r2", "k", None, "good", None, None), ("f3", "r2", "k", None, None, None, None)], "id string, run_id string, key string, score double, value string, comment string, created_at string")
    s = {r.id: r for r in importers.map_feedback(feedback, runs, "p").collect()}
    assert s.keys() == {"f1", "f2"} and s["f1"].observation_id is None and (s["f2"].observation_id, s["f2"].string_value) == ("r2", "good")
    listed = spark.createDataFrame([("o", "t", None, "GENERATION", "n", "2024-01-01T00:00:00Z", None, "WEIRD", None, "m", None, None, {"input": 2.0}, None, 0.5, None, -1.0, "pr", 3, '{"a":1}')],
        "id string, traceId string, parentObservationId string, type string, name string, startTime string, endTime string, level string, statusMessage string, model string, input string, output string, usageDetails map<string,double>, costDetails map<string,double>, calculatedInputCost double, calculatedOutputCost double, calculatedTotalCost double, promptName string, promptVersion int, metadata string")
    (r,) = importers.map_list_observations(listed, "p").collect()
    assert (r.type, r.level, dict(r.cost_details), r.metadata) == ("generation", "default", {"input": Decimal("0.5")}, {"a": "1", "prompt_name": "pr", "prompt_version": "3"})
