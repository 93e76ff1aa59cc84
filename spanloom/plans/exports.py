"""Details, trees, exports and the column functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import attributes, text, usage
from spanloom.functions import time as T
from spanloom.operators import settlement, tree, versions
from spanloom.plans import projections as P
from spanloom.plans.lists import us
from spanloom.plans.projections import with_sql
from spanloom.sources import export

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _evt(spark, sf) -> tuple[DataFrame, DataFrame]:
    return P.evt_traces(spark, sf), P.evt_observations(spark, sf)


TREE_SQL = with_sql("conv") + """, walk AS (
  SELECT trace_id, id, parent_observation_id AS parent_id, 0 AS depth, turn FROM conv c WHERE parent_observation_id IS NULL OR NOT EXISTS (FROM conv p WHERE p.trace_id = c.trace_id AND p.id = c.parent_observation_id)
  UNION ALL SELECT c.trace_id, c.id, c.parent_observation_id, w.depth + 1, c.turn FROM conv c JOIN walk w ON w.trace_id = c.trace_id AND w.id = c.parent_observation_id)"""


@query("observation_tree_depth", f"{TREE_SQL} SELECT trace_id, max(depth) AS deepest, count(*) AS nodes, count(*) FILTER (depth = 0) AS roots FROM walk GROUP BY ALL")
def observation_tree_depth(spark, sf):
    t = tree.observation_tree(P.conv_observations(spark, sf))
    return t.groupBy("trace_id").agg(F.max("depth").alias("deepest"), F.count("*").alias("nodes"), F.count_if("is_root").alias("roots"))


@query("observation_tree_dfs", f"{TREE_SQL} SELECT trace_id, id, CASE WHEN depth > 0 THEN parent_id END AS parent_id, depth, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY turn) - 1 AS INTEGER) AS place FROM walk")
def observation_tree_dfs(spark, sf):
    return tree.observation_tree(P.conv_observations(spark, sf)).select("trace_id", "id", "parent_id", "depth", "place")


@query("observation_tree_lines", with_sql("live_obs") + """, walk AS (
  SELECT project_id, trace_id, id, 0 AS depth FROM live_obs c WHERE parent_observation_id IS NULL OR NOT EXISTS (FROM live_obs p WHERE p.project_id = c.project_id AND p.trace_id = c.trace_id AND p.id = c.parent_observation_id)
  UNION ALL SELECT c.project_id, c.trace_id, c.id, w.depth + 1 FROM live_obs c JOIN walk w ON w.project_id = c.project_id AND w.trace_id = c.trace_id AND w.id = c.parent_observation_id) SELECT project_id, trace_id, id, depth, depth = 0 AS is_root FROM walk""")
def observation_tree_lines(spark, sf):
    live = versions.latest(P.ord_observations(spark, sf), "observations")
    return tree.observation_tree(live).select("project_id", "trace_id", "id", "depth", "is_root")


@query("observation_tree_collapsed", with_sql("conv") + " SELECT trace_id, id FROM conv WHERE turn <= 1")
def observation_tree_collapsed(spark, sf):
    """Conversations are chains: shutting the second turn leaves two."""
    t = tree.observation_tree(P.conv_observations(spark, sf))
    return tree.visible(t, t.where("id = '1'").select("project_id", "trace_id", "id")).select("trace_id", "id")


@query("trace_detail", f"{with_sql('docs')} SELECT id, name, epoch_us(timestamp) AS timestamp, array_to_string(tags, ',') AS tags, name AS source, md5(input) AS input_md5 FROM docs WHERE id = '42'")
def trace_detail(spark, sf):
    live = versions.latest(P.doc_traces(spark, sf).where("project_id = 'p0' and id = '42'"), "traces").limit(1)
    return live.select("id", "name", us("timestamp"), F.array_join("tags", ",").alias("tags"), F.col("metadata")["source"].alias("source"), F.md5(F.col("input").cast("binary")).alias("input_md5"))


@query("trace_scores", f"{with_sql('doc_scores')} SELECT trace_id, id, name, data_type, value FROM doc_scores")
def trace_scores(spark, sf):
    scores = versions.latest(P.doc_scores(spark, sf), "scores")
    return scores.orderBy("timestamp", "id").select("trace_id", "id", "name", "data_type", "value")


@query("children_ordered", f"{with_sql('live_obs')} SELECT project_id, trace_id, string_agg(id, ',' ORDER BY start_time, id) AS ids FROM live_obs GROUP BY ALL")
def children_ordered(spark, sf):
    live = versions.latest(P.ord_observations(spark, sf), "observations")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start_time", "id"))), lambda s: s["id"])
    return live.groupBy("project_id", "trace_id").agg(F.array_join(ids, ",").alias("ids"))


@query("langfuse_trace_items", f"""{with_sql('evt_observations', 'evt_traces')} SELECT id, '{{"id":"' || id || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(timestamp) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z","name":"day","userId":"' || user_id || '","environment":"' || environment || '","tags":[],"metadata":{{}}}}' AS item FROM evt_traces""")
def langfuse_trace_items(spark, sf):
    t = P.evt_traces(spark, sf)
    return t.select("id", export.compat_item(t).alias("item"))


@query("project_trace_list", f"{with_sql('live_traces')} SELECT project_id, id, epoch_us(timestamp) AS timestamp, name, user_id, session_id, environment, array_to_string(tags, ',') AS tags FROM live_traces WHERE project_id = 'p2'")
def project_trace_list(spark, sf):
    live = versions.latest(P.ord_traces(spark, sf).where("project_id = 'p2'"), "traces")
    return live.select("project_id", "id", us("timestamp"), "name", "user_id", "session_id", "environment", F.array_join("tags", ",").alias("tags"))


@query("project_trace_detail", f"{with_sql('live_traces')} SELECT id, release, status, third, input IS NULL AS no_input FROM (SELECT *, NULL AS input FROM live_traces) WHERE project_id = 'p2'")
def project_trace_detail(spark, sf):
    live = versions.latest(P.ord_traces(spark, sf).where("project_id = 'p2'"), "traces")
    return live.select("id", "release", F.col("metadata")["status"].alias("status"), F.col("metadata")["third"].alias("third"), F.col("input").isNull().alias("no_input"))


@query("map_values_cast", f"{with_sql('live_obs')} SELECT project_id, trace_id, id, CAST(tok_in AS DOUBLE) AS tok_in, CAST(cost_in AS DOUBLE) AS cost_in, CASE WHEN tok_total IS NOT NULL THEN 3 WHEN tok_in IS NULL THEN 0 ELSE 2 END AS keys FROM live_obs")
def map_values_cast(spark, sf):
    live = versions.latest(P.ord_observations(spark, sf), "observations")
    numbers = lambda c: F.transform_values(c, lambda _, v: v.cast("double"))
    one = live.withColumns({"u": numbers("usage_details"), "c": numbers("cost_details")})
    return one.select("project_id", "trace_id", "id", F.try_element_at("u", F.lit("input_tokens")).alias("tok_in"), F.try_element_at("c", F.lit("input")).alias("cost_in"), F.size(F.map_keys("u")).alias("keys"))


@query("stored_row_roundtrip", "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE event_id % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'null' ELSE 'none' END AS kind FROM events")
def stored_row_roundtrip(spark, sf):
    """Payload text to values: JSON's null is a value, broken text is none."""
    e = P._read(spark, sf, "events")
    stored = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "null").otherwise(F.concat("props", F.lit("}")))
    v = text.parsed(stored)
    kind = F.when(v.isNull(), "none").when(F.is_variant_null(v), "null").otherwise("object")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), kind.alias("kind"))


@query("attach_children", f"""{with_sql('conv', 'doc_scores')} SELECT trace_id AS id, count(*) AS n, string_agg(id, ',' ORDER BY start_time, id) AS ids, count(*) FILTER (output IS NOT NULL) AS answers,
(SELECT count(*) FROM doc_scores s WHERE s.trace_id = conv.trace_id) AS scores FROM conv GROUP BY ALL""")
def attach_children(spark, sf):
    """Conversations with their turns, and with the scores of the document of the same number."""
    traces = P.conv_traces(spark, sf)
    made = export.attach(traces, P.conv_observations(spark, sf), P.doc_scores(spark, sf))
    ids = F.transform("observations", lambda o: o["id"])
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return made.select("id", count("observations").alias("n"), F.array_join(ids, ",").alias("ids"), F.size(F.filter("observations", lambda o: o["output"].isNotNull())).cast("long").alias("answers"), count("scores").alias("scores"))


EXPORT = with_sql("evt_observations", "evt_traces", "evt_scores") + """, v AS (SELECT project_id, trace_id, strftime(max(event_ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(max(event_ts)) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS trace_version, epoch_us(max(event_ts)) AS version_us FROM evt_observations GROUP BY ALL)"""


def _versions(spark, sf) -> DataFrame:
    return settlement.activity(*_evt(spark, sf))


@query("exported_traces", f"{EXPORT} SELECT t.id, version_us AS trace_version, coalesce(o.n, 0) AS observations, coalesce(s.n, 0) AS scores FROM evt_traces t LEFT JOIN (SELECT trace_id, count(*) AS n FROM evt_observations GROUP BY ALL) o ON o.trace_id = t.id LEFT JOIN (SELECT trace_id, count(*) AS n FROM evt_scores GROUP BY ALL) s ON s.trace_id = t.id JOIN v ON v.trace_id = t.id")
def exported_traces(spark, sf):
    traces, observations = _evt(spark, sf)
    some = export.stamped(traces, _versions(spark, sf), "id")
    made = export.attach(some, observations, P.evt_scores(spark, sf))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return made.select("id", us("trace_version"), F.greatest(size("observations"), F.lit(0)).alias("observations"), F.greatest(size("scores"), F.lit(0)).alias("scores"))


@query("export_traces_table", f"{EXPORT} SELECT t.id, epoch_us(timestamp) AS timestamp, t.name, t.user_id, t.environment, CAST(NULL AS VARCHAR) AS release, version_us AS trace_version FROM evt_traces t JOIN v ON v.trace_id = t.id")
def export_traces_table(spark, sf):
    out = export.table(export.stamped(P.evt_traces(spark, sf), _versions(spark, sf), "id"), "traces")
    return out.select("id", us("timestamp"), "name", "user_id", "environment", "release", us("trace_version"))


@query("export_observations_table", f"{EXPORT} SELECT o.id, o.trace_id, o.name, o.level, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time, input, version_us AS trace_version FROM evt_observations o JOIN v ON v.trace_id = o.trace_id")
def export_observations_table(spark, sf):
    out = export.table(export.stamped(P.evt_observations(spark, sf), _versions(spark, sf)), "observations")
    return out.select("id", "trace_id", "name", "level", us("start_time"), us("end_time"), "input", us("trace_version"))


@query("export_scores_table", f"{EXPORT} SELECT s.id, s.trace_id, s.observation_id, value, 'numeric' AS data_type, epoch_us(timestamp) AS timestamp, version_us AS trace_version FROM evt_scores s JOIN v ON v.trace_id = s.trace_id")
def export_scores_table(spark, sf):
    out = export.table(export.stamped(P.evt_scores(spark, sf), _versions(spark, sf)), "scores")
    return out.select("id", "trace_id", "observation_id", "value", "data_type", us("timestamp"), us("trace_version"))


@query("json_lines_export", f"""{EXPORT}, lines AS (SELECT id AS trace_id, 'trace:' || id AS event, user_id AS a, environment AS b FROM evt_traces UNION ALL SELECT trace_id, 'observation:' || id, name, level FROM evt_observations UNION ALL SELECT trace_id, 'score:' || id, 'numeric', observation_id FROM evt_scores)
SELECT trace_id, event, a, b, trace_version FROM lines JOIN v USING (trace_id)""")
def json_lines_export(spark, sf):
    """The lines, read back: a field or two of every kind."""
    at = _versions(spark, sf)
    lines = export.json_lines(export.stamped(P.evt_traces(spark, sf), at, "id"), export.stamped(P.evt_observations(spark, sf), at), export.stamped(P.evt_scores(spark, sf), at))
    get = lambda *names: F.coalesce(*[F.get_json_object("line", f"$.{n}") for n in names])
    return lines.select("trace_id", get("id").alias("event"), get("body.userId", "body.dataType", "body.name").alias("a"), get("body.environment", "body.level", "body.observationId").alias("b"), get("traceVersion").alias("trace_version"))


SPANS = f"""{with_sql('evt_observations')} , spans AS (SELECT trace_id AS trace, id, start_time, substr(sha256('trace:' || trace_id), 1, 32) AS traceId, substr(sha256('span:' || id), 1, 16) AS spanId, coalesce(name, id) AS name, CAST(epoch_us(start_time) // 1000 AS VARCHAR) || '000000' AS startTimeUnixNano,
CAST(epoch_us(end_time) // 1000 AS VARCHAR) || '000000' AS endTimeUnixNano, CASE level WHEN 'error' THEN 2 ELSE 1 END AS statusCode FROM evt_observations)"""


@query("otlp_reemission_spans", f"{SPANS} SELECT traceId, spanId, name, startTimeUnixNano, endTimeUnixNano, statusCode FROM spans")
def otlp_reemission_spans(spark, sf):
    traces, observations = _evt(spark, sf)
    spans = export.otlp_spans(traces, tree.observation_tree(observations), observations)
    return spans.select("traceId", "spanId", "name", "startTimeUnixNano", "endTimeUnixNano", "statusCode")


@query("otlp_requests", f"""{SPANS} SELECT trace AS trace_id, count(*) AS spans, count(endTimeUnixNano) AS ends, sum(statusCode) AS codes, string_agg(spanId, ',' ORDER BY start_time, id) AS span_ids FROM spans GROUP BY ALL""")
def otlp_requests(spark, sf):
    """The requests' bodies, read back."""
    traces, observations = _evt(spark, sf)
    made = export.otlp_requests(export.otlp_spans(traces, tree.observation_tree(observations), observations))
    shape = "resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<spanId:string,endTimeUnixNano:string,status:struct<code:bigint>>>>>>>"
    spans = F.from_json("body", shape)["resourceSpans"][0]["scopeSpans"][0]["spans"]
    total = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["status"]["code"])
    ends = F.size(F.filter(spans, lambda s: s["endTimeUnixNano"].isNotNull())).cast("long")
    return made.select("trace_id", F.size(spans).cast("long").alias("spans"), ends.alias("ends"), total.alias("codes"), F.array_join(F.transform(spans, lambda s: s["spanId"]), ",").alias("span_ids"))


@query("versioned_trace", f"{with_sql('live_traces', 'live_obs')} SELECT t.id, epoch_us(timestamp) AS timestamp, epoch_us(greatest(t.event_ts, (SELECT max(event_ts) FROM live_obs o WHERE o.trace_id = t.id))) AS version FROM live_traces t WHERE id = '1001'")
def versioned_trace(spark, sf):
    ids = spark.createDataFrame([("p1", "1001")], "project_id string, trace_id string")
    return settlement.versioned(P.ord_traces(spark, sf), P.ord_observations(spark, sf), ids=ids).select("id", us("timestamp"), us("trace_version", "version"))


# Column functions
@query("scalar_time", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) - 1 AS before, epoch_us(ts) // 1000 * 1000 AS cut,
CAST(epoch_us(ts) // 1000 AS VARCHAR) || '000000' AS nanos, (epoch_us(ts) * 1000 + event_id % 1000) // 1000000 * 1000 AS from_nanos, ts >= TIMESTAMP '2024-01-13 12:00:00' AS last_week FROM events""")
def scalar_time(spark, sf):
    e = P._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ts = F.col("ts")
    nanos = F.concat((F.unix_micros("ts").cast("decimal(20,0)") * 1000 + F.col("event_id") % 1000).cast("decimal(20,0)").cast("string"))
    since = T.preset_from(datetime(2024, 1, 20, 12), "7d")
    return e.select("event_id", T.to_iso(ts).alias("iso"), F.date_format(T.sort_day(ts), "yyyy-MM-dd").alias("day"), F.unix_micros(T.shift_micros(ts, -1)).alias("before"), F.unix_micros(T.millis(ts)).alias("cut"), T.to_unix_nano(ts).alias("nanos"), F.unix_micros(T.from_unix_nano(nanos)).alias("from_nanos"), (ts >= F.lit(since)).alias("last_week"))


@query("scalar_sanitize", """SELECT event_id, CASE WHEN value >= 50 THEN CAST(floor(value - 50 + 0.5) AS BIGINT) END AS tokens, CASE WHEN value >= 50 THEN round(value - 50, 2) END AS cost, CASE event_type WHEN 'error' THEN 'error' ELSE 'default' END AS level,
CASE WHEN event_type IN ('view', 'click') THEN event_type END AS environment, CASE WHEN event_id % 4 > 0 THEN 'id ' || event_id END AS identifier, 'lf_' || substr(sha256(props), 1, 32) AS record_id, CASE event_id % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'categorical' END AS score_type,
CASE WHEN event_id % 2 = 0 THEN round(value, 2) END AS parsed FROM events""")
def scalar_sanitize(spark, sf):
    e = P._read(spark, sf, "events")
    value, key = F.round(F.col("value"), 2), F.col("event_id")
    shifted = F.round(value - 50, 2)
    env = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("  "), "event_type", F.lit("  "))).when(F.col("event_type") == "error", "a\u0007b").when(F.col("event_type") == "signup", F.repeat(F.lit("x"), 65))
    ident = F.when(key % 4 == 0, " 　 ").otherwise(F.concat(F.lit("\tid "), key, F.lit("\n")))
    decimal = F.when(key % 2 == 0, value.cast("string")).when(key % 4 == 1, "-1").otherwise("much")
    return e.select(
        "event_id", usage.token_count(shifted).cast("long").alias("tokens"), F.round(usage.cost_amount(shifted).cast("double"), 2).alias("cost"), text.one_of(F.upper("event_type"), text.LEVELS, "default").alias("level"), text.environment(env).alias("environment"),
        text.identifier(ident).alias("identifier"), text.record_id(F.col("props")).alias("record_id"), text.score_type(F.when(key % 3 == 0, 1.0), F.when(key % 3 == 1, "x")).alias("score_type"), F.round(usage.decimal_cost(decimal).cast("double"), 2).alias("parsed"),
    )


@query("scalar_attributes", """SELECT event_id, event_type AS first, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 's' || event_id END AS session, CAST(round(value, 2) AS DOUBLE) AS number, CASE WHEN event_id % 3 > 0 THEN CAST(CAST(event_id AS DOUBLE) AS VARCHAR) END AS seed, 'last' AS repeated, event_id % 5 = 0 AS root FROM events""")
def scalar_attributes(spark, sf):
    e = P._read(spark, sf, "events")
    key = F.col("event_id")
    null = F.lit(None).cast("string")
    value = lambda s=null, i=null, d=F.lit(None).cast("double"): F.struct(s.alias("stringValue"), i.alias("intValue"), d.alias("doubleValue"), F.lit(None).cast("boolean").alias("boolValue"), null.alias("arrayValue"), null.alias("kvlistValue"), null.alias("bytesValue"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    session = F.when(key % 2 == 0, F.concat(F.lit("u"), "user_id")).otherwise("")
    span = F.array(pair("a", value(F.col("event_type"))), pair("a", value(F.lit("second"))), pair("session", value(session)), pair("n", value(d=F.round(F.col("value"), 2))), pair("gen_ai.request.seed", value(i=F.when(key % 3 > 0, key.cast("string")))), pair("r", value(F.lit("first"))), pair("r", value(F.lit("last"))))
    resource = F.array(pair("session", value(F.concat(F.lit("s"), key))))
    made = e.withColumns({"span": span, "resource": resource})
    s, r = F.col("span"), F.col("resource")
    parent = F.when(key % 5 > 0, "p")
    return made.select("event_id", attributes.string_of(s, "a").alias("first"), attributes.first_string([s, r], ["session"]).alias("session"), attributes.number_of(s, "n").alias("number"), attributes.model_parameters(s, ("gen_ai.request.seed",), "gen_ai.request.")["seed"].alias("seed"), attributes.as_map(s)["r"].alias("repeated"), F.coalesce(parent, F.lit("")).eqNullSafe("").alias("root"))


@query("raw_key_parse", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'p' || (user_id % 3) END AS project_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS batch_id FROM events""")
def raw_key_parse(spark, sf):
    e = P._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    good = text.raw_key(F.concat(F.lit("p"), F.col("user_id") % 3), F.col("ts"), F.col("event_id").cast("string"))
    key = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.concat(F.lit("raw/p/2024/02/30/"), F.col("event_id"), F.lit(".json"))).otherwise(F.concat(F.lit("x"), good))
    k = text.parse_raw_key(key)
    return e.select("event_id", k["project_id"].alias("project_id"), F.date_format(k["day"], "yyyy-MM-dd").alias("day"), k["batch_id"].alias("batch_id"))


@query("raw_day_cutoff", "SELECT event_id FROM events WHERE CAST(ts AS DATE) < CAST(TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY AS DATE)")
def raw_day_cutoff(spark, sf):
    """Objects of whole days before the cutoff's own day."""
    e = P._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = text.raw_key(F.lit("p"), F.col("ts"), F.col("event_id").cast("string"))
    cut = F.to_date(F.lit(T.days_ago(datetime(2024, 1, 20, 12), 7)))
    return e.where(text.parse_raw_key(key)["day"] < cut).select("event_id")


def _pad(byte: int) -> str:
    """The key ``secret`` of HMAC's inner or outer hash, as hex."""
    return bytes(c ^ byte for c in b"secret".ljust(64, b"\0")).hex()


@query("signed_bodies", f"""{with_sql('evt_observations', 'evt_traces')} SELECT id, body, sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode(body)))) AS signature FROM (SELECT id,
'{{"id":"' || id || '","name":"day","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(timestamp) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z","userId":"' || user_id || '","tags":[]}}' AS body FROM evt_traces)""")
def signed_bodies(spark, sf):
    return export.webhook_bodies(P.evt_traces(spark, sf), "secret").select("id", "body", "signature")
