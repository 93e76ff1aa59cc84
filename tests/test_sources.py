"""Messages within budgets, and objects page by page."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import text
from spanloom.operators import paging
from spanloom.plans import services
from spanloom.sources import importers, messages, objects, otlp, raw
from spanloom.streaming.ledger import Files
from test_ingest import attribute, event, land, read
from test_scale import planned


def listing(n, parts=1, content="x", **more):
    return [{"role": "user", "parts": [{"type": "text", "content": content}] * parts, **more} for _ in range(n)]


@pytest.mark.parametrize("found, output, fine", [
    (listing(200), False, True), (listing(201), False, False), (listing(1, 200), False, True), (listing(2, 101), False, False), ([], False, True), ({}, False, False),
    (listing(1), True, False), (listing(1, finish_reason="stop"), True, True), ([{"role": 1, "parts": []}], False, False), ([{"role": "u", "parts": ["x"]}], False, False), ([{"role": "u", "content": "x"}], False, False),
])
def test_shape_of_messages(found, output, fine):
    assert (messages.read(json.dumps(found), None, output)[0] is not None) == fine


def test_bounds_of_an_attribute():
    inside = json.dumps(listing(1, content="x" * 100_000))
    assert messages.read(inside, None, False)[0] == json.dumps(json.loads(inside), separators=(",", ":"))
    over = json.dumps(listing(1, content="é" * 70_000), ensure_ascii=False)
    assert messages.read(over, None, False) == (None, 0, 0)  # too long: nothing is read
    assert messages.read("{no", None, False) == (None, 3, 0)
    deep = json.dumps([{"role": "u", "parts": [{"type": "t", "v": [1] * 9_993}]}])
    assert messages.read(deep, None, False)[1:] == (len(deep), 10_000) and messages.read(deep, None, False)[0]
    deeper = json.dumps([{"role": "u", "parts": [{"type": "t", "v": [1] * 9_994}]}])
    assert messages.read(deeper, None, False) == (None, len(deeper), 10_000)
    assert messages.read('[{"role":"u","parts":[],"n":9007199254740993,"m":1e400,"k":1.0,"j":1e20}]', None, False)[0] == '[{"role":"u","parts":[],"n":"9007199254740993","m":"1e400","k":1,"j":"1e20"}]'
    assert messages.read('[{"role":"u","parts":[],"n":NaN}]', None, False)[0] is None
    assert messages.read("[" * 50_000, None, False)[0] is None


def test_nested_values():
    string = lambda s: {"stringValue": s}
    pairs = lambda **kv: {"kvlistValue": {"values": [{"key": k, "value": v} for k, v in kv.items()]}}
    array = lambda *v: {"arrayValue": {"values": list(v)}}
    value = array(pairs(role=string("user"), n={"intValue": "12"}, big={"intValue": "9007199254740993"}, parts=array(pairs(type=string("text")))))
    assert messages.read(None, json.dumps(value), False) == ('[{"role":"user","n":12,"big":"9007199254740993","parts":[{"type":"text"}]}]', 43, 8)
    twice = {"kvlistValue": {"values": [{"key": "a", "value": string("x")}] * 2}}
    assert messages.read(None, json.dumps(array(twice)), False)[0] is None
    assert messages.read(None, json.dumps(array({})), False)[0] is None
    assert messages.read(None, json.dumps(array(*[string("")] * 10_000)), False) == (None, 0, 10_001)


def test_budget_of_an_export(spark, tmp_path):
    big = json.dumps(listing(1, content="x" * 120_000))
    span = lambda i, text: {"traceId": "t", "spanId": f"s{i}", "name": "n", "startTimeUnixNano": "1714554000500000000", "attributes": [attribute("gen_ai.input.messages", stringValue=text)]}
    export = lambda spans: {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": spans}]}]}
    small = json.dumps(listing(1))
    land(tmp_path, "b1", [event(1, "otlp-export", "otlp", export([span(i, big) for i in range(4)] + [span(4, small), span(5, big), span(6, small)])), event(2, "otlp-export", "otlp", export([span(9, small)]))])
    got = {r.id: r.input is not None for r in otlp.observations(otlp.spans(raw.events(read(spark, tmp_path)))).collect()}
    assert got == {"s0": True, "s1": True, "s2": True, "s3": True, "s4": True, "s5": False, "s6": False, "s9": True}


class Counted(Files):
    def __init__(self, spark):
        super().__init__(spark)
        self.opened = []

    def listed(self, path):
        self.opened.append(path)
        return super().listed(path)


def test_objects_page_by_page(spark, tmp_path):
    keys = sorted(f"raw/{p}/2024/05/{d:02d}/b{n}.json" for p in ("p1", "p2") for d in range(1, 6) for n in range(3)) + ["raw/p1.json"]
    for k in keys:
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text("x" * 10)
    files = Counted(spark)
    assert [k for k, _ in objects.walk(files, str(tmp_path))] == sorted(keys)
    files.opened.clear()
    after = "raw/p1/2024/05/03/b1.json"
    assert [k for k, _ in objects.walk(files, str(tmp_path), "raw/p1/", after)] == [k for k in sorted(keys) if k.startswith("raw/p1/") and k > after]
    assert [m[1] for o in files.opened if (m := re.search(r"/2024/05/(\d\d)/$", o))] == ["03", "04", "05"]  # no earlier day, no other project
    got, start, cuts = [], "", []
    while True:
        found = objects.page(files, str(tmp_path), "raw/", start, most_objects=7, most_bytes=65)
        got += [k for k, _ in found.objects]
        cuts.append(found.cut)
        if not found.cut:
            break
        start = found.last
    assert got == sorted(keys) and set(cuts[:-1]) == {"bytes"} and len(cuts) == 6
    assert objects.page(files, str(tmp_path), most_objects=2).cut == "objects" and objects.page(files, str(tmp_path), most_response=60).cut == "response"
    assert len(objects.page(files, str(tmp_path), most_bytes=1).objects) == 1 and objects.page(files, str(tmp_path / "none")).objects == []
    assert objects.listed(spark, found).count() == len(found.objects)


def test_batches_of_a_page(spark, tmp_path):
    land(tmp_path, "b1", [event(1, "trace-upsert", "native", {"id": "t"})])
    found = objects.page(Files(spark), str(tmp_path), "raw/")
    assert raw.events(objects.batches_of(spark, str(tmp_path), found)).select(F.col("object_key")).first().object_key == found.objects[0][0]


def test_inventories_of_raw_objects_and_media(spark, tmp_path):
    at = "timestamp'2024-05-01 00:00:00'"
    found = spark.createDataFrame([("raw/p/2024/05/01/a.json", 5), ("raw/p/2024/05/02/b.json", 7), ("raw/p/2024/05/03/c.json", 9), ("else", 1)], "object_key string, size long").withColumn("modified_at", F.expr(at))
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "object_key string")
    told = {r.state: (r.objects, r.bytes) for r in raw.inventory(found, key("raw/p/2024/05/01/a.json", "raw/p/2024/05/01/a.json"), key("raw/p/2024/05/02/b.json")).collect()}
    assert told == {"pending": (1, 5), "failed": (1, 7), "done": (2, 10)}
    due = raw.due_objects(found, F.to_date(F.lit("2024-05-03")))
    assert sorted(r.object_key[-6:] for r in due.collect()) == ["a.json", "b.json"]
    media = spark.createDataFrame([("m1", bytearray(b"x")), ("m2", bytearray(b"x")), ("m3", bytearray(b"yy")), ("m4", bytearray(b"zzz"))], "path string, content binary").withColumn("modificationTime", F.expr(at))
    known = media.where("path = 'm4'").select(F.sha2("content", 256).alias("sha256"))
    new = raw.media_assets(media, known)
    assert sorted((r.path, r.bytes) for r in new.collect()) == [("m1", 1), ("m3", 2)]
    (t,) = raw.media_totals(new).collect()
    assert (t.assets, t.bytes) == (2, 3) and raw.media_totals(new.where("false")).first().bytes == 0


def test_landed_batches_are_read_back(spark, tmp_path):
    events = "array<struct<id:string,type:string,source:string,schemaVersion:int,idempotencyKey:string,body:string>>"
    batches = spark.createDataFrame([("p", "b1", "2024-05-01T10:00:00Z", [("e1", "trace-upsert", "native", 1, "e1", "{}")])], f"projectId string, batchId string, receivedAt string, events {events}")
    raw.land(batches, str(tmp_path / "landed"))
    got = raw.events(raw.read_batches(spark, f"{tmp_path}/landed/*/*.txt"))
    assert [(r.project_id, r.batch_id, r.id, r.type) for r in got.collect()] == [("p", "b1", "e1", "trace-upsert")]


def test_small_helpers(spark):
    assert paging.cut_page([1, 2, 3], 2) == ([1, 2], True) and paging.cut_page([1], 2) == ([1], False)
    row = spark.sql("select map('a', 1, 'b', null) m").select(text.stringified(F.col("m")).alias("m")).first()
    assert row.m == {"a": "1", "b": ""}
    mixed = importers.mixed_identity(spark.createDataFrame([("t", "p1"), ("t", "p2"), ("u", "p1"), ("u", "p1")], "id string, project_id string"))
    assert [r.id for r in mixed.collect()] == ["t"]
    schemas.require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    with pytest.raises(ValueError, match="Paris"):
        schemas.require_utc(spark)
    schemas.utc(spark)


def test_stored_events_of_any_payload(spark, tmp_path):
    """An event keeps its other fields whatever its payload is, and only an object's own ``k`` is read."""
    told = {'{"k": 7}': "7", '{"j": {"k": 3}, "k": "a\\"b"}': 'a"b', '{"k": {"a": [1, 2]}}': '{"a":[1,2]}', '{"k": null}': None, "{}": None, "[1]": None, '[{"k": 1}]': None, '"{\\"k\\": 1}"': None, "5": None, "null": None, "no {": None, "": None, None: None}
    rows = [(n, n, "click", 1.0, props) for n, props in enumerate(told)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_millis(F.lit(1704067200123) + F.col("event_id")))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = services.stored_event_objects(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted((str(n), "click", k, 1704067200123 + n) for n, k in enumerate(told.values()))
    assert planned(got).count("from_json") == 1 and "get_json_object" not in planned(got)


def test_stored_turns_keep_their_text(spark, tmp_path):
    """Whatever a turn says is its payload, also what reads as JSON or as a field of the object."""
    said = ["plain", "a\tb\n\"q\" \\ \u2028 \U0001f600", "", " ", "1.50", "007", "null", "true", '"abc"', '{ "a" : [1, 2.0] }', '{"a":1,"a":2}', '{"input": "x", "id": "y"}', "[]", " 12 ", "1e400", "NaN", '{"k": 1} x', None]
    turns = spark.createDataFrame([(c, n, role, said[n]) for c, role in enumerate(("user", "assistant")) for n in range(len(said))], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = services.stored_turn_objects(spark, str(tmp_path))
    assert {(r.trace_id, int(r.id)): r.payload for r in got.collect()} == {(str(c), n): t for c in range(2) for n, t in enumerate(said)}
    fields = {(r.trace_id, int(r.id)): r.fields for r in got.collect()}
    assert fields["0", 0] == "projectId,id,traceId,name,startTime,input" and fields["1", 6] == "projectId,id,traceId,parentObservationId,name,startTime,output"
    assert fields["1", len(said) - 1] == "projectId,id,traceId,parentObservationId,name,startTime"
    assert planned(got).count("from_json") == 1 and "get_json_object" not in planned(got)
