"""What leaves: typed tables, JSON lines that ingest reads back, OTLP requests, webhook bodies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.functions import text
from spanloom.functions.time import to_iso, to_unix_nano

#: Exported columns and their types.
TRACE_TABLE = {"id": "string", "timestamp": "timestamp", "name": "string", "user_id": "string", "session_id": "string", "environment": "string", "release": "string", "version": "string", "tags": "array<string>", "metadata": "map<string,string>", "input": "string", "output": "string", "trace_version": "timestamp"}
OBSERVATION_TABLE = {"id": "string", "trace_id": "string", "parent_observation_id": "string", "type": "string", "name": "string", "start_time": "timestamp", "end_time": "timestamp", "level": "string", "status_message": "string", "model": "string", "model_parameters": "map<string,string>", "input": "string", "output": "string", "usage_details": "map<string,decimal(20,0)>", "cost_details": "map<string,decimal(18,9)>", "completion_start_time": "timestamp", "metadata": "map<string,string>", "trace_version": "timestamp"}
SCORE_TABLE = {"id": "string", "trace_id": "string", "observation_id": "string", "name": "string", "data_type": "string", "value": "double", "string_value": "string", "source": "string", "comment": "string", "metadata": "map<string,string>", "timestamp": "timestamp", "trace_version": "timestamp"}
TABLES = {"traces": TRACE_TABLE, "observations": OBSERVATION_TABLE, "scores": SCORE_TABLE}


def table(df: DataFrame, kind: str) -> DataFrame:
    """The rows as exported: fixed columns and types; what the input lacks is null."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in TABLES[kind].items()])


def filled(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with what it lacks of the exported columns as nulls; other columns stay."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in TABLES[kind].items() if c not in df.columns})


def stamped(df: DataFrame, versions: DataFrame, trace_id: str = "trace_id") -> DataFrame:
    """Rows of the traces in ``versions`` (project_id, trace_id, version), with trace_version."""
    at = versions.select("project_id", F.col("trace_id").alias(trace_id), F.col("version").cast("timestamp").alias("trace_version"))
    return df.join(at, ["project_id", trace_id])


def write_parquet(parts: dict[str, DataFrame], path: str) -> None:
    """A folder per table; a table without rows isn't written."""
    for kind, df in parts.items():
        out = table(df, kind)
        if out.head(1):
            out.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{kind}")


def _event(kind: str, key: Column, body: Column) -> Column:
    return F.to_json(F.struct(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(f"{kind}-upsert").alias("type"), F.lit("native").alias("source"), F.lit(1).alias("schemaVersion"), F.concat(F.lit(f"{kind}:"), key).alias("idempotencyKey"), body.alias("body"), to_iso(F.col("trace_version")).alias("traceVersion")))


def json_lines(traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """(trace_id, place, line): native events without project, a trace's row first, then its observations and
    scores. Times are ISO text, so that ingest takes the lines as they are."""
    traces, observations, scores = filled(traces, "traces"), filled(observations, "observations"), filled(scores, "scores")
    iso = lambda c: to_iso(F.col(c))
    trace = F.struct("id", iso("timestamp").alias("timestamp"), "name", F.col("user_id").alias("userId"), F.col("session_id").alias("sessionId"), "environment", "release", "version", "tags", "metadata", "input", "output")
    observation = F.struct(
        "id", F.col("trace_id").alias("traceId"), F.col("parent_observation_id").alias("parentObservationId"), "type", "name", iso("start_time").alias("startTime"), iso("end_time").alias("endTime"), "level", F.col("status_message").alias("statusMessage"), "model", F.when(F.size("model_parameters") > 0, F.col("model_parameters")).alias("modelParameters"),
        iso("completion_start_time").alias("completionStartTime"), "metadata", "input", "output", F.when(F.size("usage_details") > 0, F.col("usage_details")).alias("usageDetails"), F.when(F.size("cost_details") > 0, F.col("cost_details")).alias("costDetails"),
    )
    score = F.struct("id", F.col("trace_id").alias("traceId"), F.col("observation_id").alias("observationId"), "name", F.col("data_type").alias("dataType"), "value", F.col("string_value").alias("stringValue"), "source", "comment", "metadata", iso("timestamp").alias("timestamp"))
    parts = [
        traces.select(F.col("id").alias("trace_id"), F.struct(F.lit(0).alias("table"), F.col("timestamp").alias("at"), "id").alias("place"), _event("trace", F.col("id"), trace).alias("line")),
        observations.select("trace_id", F.struct(F.lit(1).alias("table"), F.col("start_time").alias("at"), "id").alias("place"), _event("observation", F.col("id"), observation).alias("line")),
        scores.select("trace_id", F.struct(F.lit(2).alias("table"), F.col("timestamp").alias("at"), "id").alias("place"), _event("score", F.col("id"), score).alias("line")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_json_lines(lines: DataFrame, path: str) -> None:
    """A trace's lines stand together and in order."""
    lines.repartition("trace_id").sortWithinPartitions("trace_id", "place").select("line").write.mode("overwrite").text(path)


def _by_time(time: str):
    def compare(a: Column, b: Column) -> Column:
        one, two = (F.struct(r[time], r["id"]) for r in (a, b))
        return F.when(one < two, -1).when(one > two, 1).otherwise(0)

    return compare


def attach(traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Traces with ``observations`` and ``scores`` as arrays, by time and id."""
    key = ["project_id", "id"]
    for name, df, time in (("observations", observations, "start_time"), ("scores", scores, "timestamp")):
        row = F.struct(*[c for c in df.columns if c not in ("project_id", "trace_id")])
        lists = df.groupBy("project_id", F.col("trace_id").alias("id")).agg(F.array_sort(F.collect_list(row), _by_time(time)).alias(name))
        traces = traces.join(lists, key, "left")
    return traces


def otlp_spans(traces: DataFrame, tree: DataFrame, observations: DataFrame) -> DataFrame:
    """A span per observation, with ids made from ours; a trace without observations gets one span of its own
    name and time. What isn't an error has status 1, a span without a name has its id, and an end that isn't
    known stays out."""
    key = ["project_id", "trace_id"]
    string = lambda k, v: F.struct(k.alias("key"), F.struct(v.alias("stringValue"), F.lit(None).cast("string").alias("intValue")).alias("value"))
    number = lambda k: F.try_element_at("usage_details", F.lit(k)).cast("string")
    count = lambda k: F.struct(F.lit(f"gen_ai.usage.{k}").alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), number(k).alias("intValue")).alias("value"))
    model = F.when(F.coalesce("model", F.lit("")) != "", string(F.lit("gen_ai.request.model"), F.col("model")))
    counts = [F.when(number(k).isNotNull(), count(k)) for k in ("input_tokens", "output_tokens")]
    own = F.transform(F.map_entries(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))), lambda e: string(e["key"], e["value"]))
    placed = tree.select(*key, "id", "parent_id", "place").join(filled(observations, "observations"), [*key, "id"])
    spans = placed.select(
        *key, "place", text.otlp_trace_id(F.col("trace_id")).alias("traceId"), text.otlp_span_id(F.col("id")).alias("spanId"), text.otlp_span_id(F.col("parent_id")).alias("parentSpanId"), F.coalesce("name", "id").alias("name"),
        to_unix_nano(F.col("start_time")).alias("startTimeUnixNano"), to_unix_nano(F.col("end_time")).alias("endTimeUnixNano"), F.concat(own, F.array_compact(F.array(model, *counts))).alias("attributes"),
        F.when(F.col("level") == "error", 2).otherwise(1).alias("statusCode"), F.nullif("status_message", F.lit("")).alias("statusMessage"),
    )
    bare = traces.withColumnRenamed("id", "trace_id").join(observations.select(*key).distinct(), key, "left_anti")
    none = F.lit(None).cast("string")
    alone = bare.select(
        *key, F.lit(0).alias("place"), text.otlp_trace_id(F.col("trace_id")).alias("traceId"), text.otlp_span_id(F.col("trace_id")).alias("spanId"), none.alias("parentSpanId"), F.coalesce("name", "trace_id").alias("name"),
        to_unix_nano(F.col("timestamp")).alias("startTimeUnixNano"), none.alias("endTimeUnixNano"), F.array().cast(spans.schema["attributes"].dataType).alias("attributes"), F.lit(1).alias("statusCode"), none.alias("statusMessage"),
    )
    return spans.unionByName(alone)


def otlp_requests(spans: DataFrame, service: str = "spanloom") -> DataFrame:
    """(project_id, trace_id, body): one export request per trace, as JSON."""
    status = F.struct(F.col("statusCode").alias("code"), F.col("statusMessage").alias("message"))
    span = F.struct("place", F.struct("traceId", "spanId", "parentSpanId", "name", "startTimeUnixNano", "endTimeUnixNano", "attributes", status.alias("status")).alias("span"))
    lists = spans.groupBy("project_id", "trace_id").agg(F.transform(F.array_sort(F.collect_list(span)), lambda s: s["span"]).alias("spans"))
    name = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value")))
    scope = F.array(F.struct(F.struct(F.lit(service).alias("name")).alias("scope"), F.col("spans").alias("spans")))
    return lists.select("project_id", "trace_id", F.to_json(F.struct(F.array(F.struct(F.struct(name.alias("attributes")).alias("resource"), scope.alias("scopeSpans"))).alias("resourceSpans"))).alias("body"))


def webhook_bodies(traces: DataFrame, secret: str) -> DataFrame:
    """(project_id, id, body, signature) of trace summaries."""
    body = F.to_json(F.struct("id", "name", to_iso(F.col("timestamp")).alias("timestamp"), F.col("user_id").alias("userId"), "tags"))
    return traces.select("project_id", "id", body.alias("body")).withColumn("signature", text.hmac_sha256(F.col("body"), secret))


def _compat(df: DataFrame, fields: dict[str, Column | str]) -> Column:
    """JSON of the fields in the compatible read form; what is null stays out, and so do the columns that ``df`` lacks."""
    known = {k: v for k, v in fields.items() if not isinstance(v, str) or v in df.columns}
    return F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in known.items()]))


def compat_item(df: DataFrame) -> Column:
    """A trace in the compatible read form: camel case, absent fields left out."""
    return _compat(df, {
        "id": "id", "timestamp": to_iso(F.col("timestamp")), "name": "name", "userId": "user_id", "sessionId": "session_id", "environment": "environment", "release": "release", "version": "version",
        "tags": "tags", "metadata": "metadata", "input": "input", "output": "output",
    })


def compat_observation(df: DataFrame) -> Column:
    """An observation in the compatible read form; types and levels are upper case."""
    filled_map = lambda c: F.when(F.size(c) > 0, F.col(c))
    return _compat(df, {
        "id": "id", "traceId": "trace_id", "parentObservationId": "parent_observation_id", "type": F.upper("type"), "name": "name", "startTime": to_iso(F.col("start_time")), "endTime": to_iso(F.col("end_time")),
        "completionStartTime": to_iso(F.col("completion_start_time")) if "completion_start_time" in df.columns else "completion_start_time", "level": F.upper("level"), "statusMessage": "status_message", "model": "model",
        "modelParameters": "model_parameters", "input": "input", "output": "output", "metadata": "metadata", "usageDetails": filled_map("usage_details"), "costDetails": filled_map("cost_details"),
    })


def compat_score(df: DataFrame) -> Column:
    """A score in the compatible read form; types and sources are upper case."""
    return _compat(df, {
        "id": "id", "traceId": "trace_id", "observationId": "observation_id", "name": "name", "dataType": F.upper("data_type"), "value": "value", "stringValue": "string_value", "source": F.upper("source"),
        "comment": "comment", "metadata": "metadata", "timestamp": to_iso(F.col("timestamp")),
    })


def stored_object(df: DataFrame) -> Column:
    """A stored row as the object it stands for, as JSON: nulls and empty maps are absent, and a payload that is JSON is
    its value, any other its text."""
    payload = lambda c: F.coalesce(text.parsed(F.col(c)), F.col(c).cast("variant"))

    def value(name: str, kind: str) -> Column:
        if name in ("input", "output"):
            return payload(name)
        if kind.startswith("map"):
            return F.when(F.size(name) > 0, F.col(name))
        return to_iso(F.col(name)) if kind == "timestamp" else F.col(name)

    camel = lambda n: n.split("_")[0] + "".join(x.title() for x in n.split("_")[1:])
    return F.to_json(F.struct(*[value(n, t).alias(camel(n)) for n, t in df.dtypes if n not in ("event_ts", "is_deleted", "seq")]))


def tree_response(traces: DataFrame, tree: DataFrame, observations: DataFrame) -> DataFrame:
    """(project_id, id, body): a trace with its observations nested below their parents, as JSON."""
    rows = tree.join(observations, ["project_id", "trace_id", "id"]).select(
        "project_id", F.col("trace_id").alias("trace"), "place", "depth", F.to_json(F.struct("id", "name", "type", to_iso(F.col("start_time")).alias("startTime"), to_iso(F.col("end_time")).alias("endTime"), "level", "model")).alias("node")
    )
    lists = rows.groupBy("project_id", F.col("trace").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "depth", "node"))).alias("nodes"))
    head = F.to_json(F.struct("id", "name", to_iso(F.col("timestamp")).alias("timestamp"), "tags"))
    return traces.select("project_id", "id", head.alias("head")).join(lists, ["project_id", "id"], "left").select("project_id", "id", nested_json(F.col("head"), F.col("nodes.depth"), F.col("nodes.node")).alias("body"))


@F.pandas_udf(StringType())
def nested_json(head: pd.Series, depths: pd.Series, nodes: pd.Series) -> pd.Series:
    """Nodes in depth-first order put below each other by their depth."""

    def one(h: str, ds: object, ns: object) -> str:
        out = json.loads(h)
        path = [out]
        out["observations"] = []
        for d, n in zip(ds if ds is not None else (), ns if ns is not None else (), strict=True):
            node = {**json.loads(n), "children": []}
            del path[d + 1 :]
            path[-1]["observations" if len(path) == 1 else "children"].append(node)
            path.append(node)
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(*x) for x in zip(head, depths, nodes, strict=True)], dtype=object)


def content_hash(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, content_hash) of everything that rows with the key hold, whatever their order."""
    line = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in key)))
    return rows.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("content_hash"))


def raw_slice(index: DataFrame, events: DataFrame, most_objects: int, most_bytes: int) -> DataFrame:
    """(project_id, trace_id, object_key, event_id, match, truncated) for the indexed objects of traces: their
    events that concern the trace, objects beyond the caps named with why they are left out."""
    from spanloom.operators.refs import within_caps
    from spanloom.sources.raw import concerns

    sizes = events.groupBy("project_id", "object_key").agg(F.sum(F.octet_length("body")).alias("size"))
    capped = within_caps(index.join(sizes, ["project_id", "object_key"]), most_objects, most_bytes)
    open_ = capped.where("truncated is null").join(events.withColumnRenamed("id", "event_id").drop("received_at"), ["project_id", "object_key"]).withColumn("match", concerns(F.col("trace_id"))).where("match <> 'NO'")
    shut = capped.where("truncated is not null").select("project_id", "trace_id", "object_key", F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("match"), "truncated")
    return open_.select("project_id", "trace_id", "object_key", "event_id", "match", F.lit(None).cast("string").alias("truncated")).unionByName(shut)
