"""Mappers over wire shapes that are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import display, text
from spanloom.functions import time as T
from spanloom.plans import projections as P
from spanloom.plans.lists import us
from spanloom.sources import compat, importers, native, otlp, raw

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _events(spark, sf) -> DataFrame:
    return P._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _wire(df: DataFrame, id_: Column, kind: Column | str, source: str, body: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(
        F.lit("p").alias("project_id"), F.lit("b").alias("batch_id"), F.to_timestamp(F.lit("2024-06-01T00:00:00Z")).alias("received_at"), F.lit("raw/p/2024/06/01/b.json").alias("object_key"),
        F.lit(0).alias("ordinal"), id_.cast("string").alias("id"), kind.alias("type"), F.lit(source).alias("source"), body.alias("body"),
    )


def native_events(spark, sf) -> DataFrame:
    """Events are observations, every tenth without a trace; purchases are scores as well, every third without a
    value; signups are traces."""
    e = _events(spark, sf)
    key, trace = F.col("event_id"), F.concat(F.lit("u"), "user_id")
    usage = F.create_map(F.lit("input"), key % 50, F.lit("output_tokens"), key % 7)
    observation = F.to_json(F.struct(F.concat(F.lit(" o"), key).alias("id"), F.when(key % 10 > 0, trace).alias("traceId"), F.lit("event").alias("type"), F.col("event_type").alias("name"), T.to_iso(F.col("ts")).alias("startTime"), F.when(F.col("event_type") == "error", "error").alias("level"), usage.alias("usageDetails")))
    score = F.to_json(F.struct(F.concat(F.lit("s"), key).alias("id"), trace.alias("traceId"), F.lit("spent").alias("name"), F.lit("api").alias("source"), F.when(key % 3 > 0, F.round("value", 2)).alias("value")))
    body = F.to_json(F.struct(F.concat(F.lit("t"), key).alias("id"), T.to_iso(F.col("ts")).alias("timestamp"), F.when(key % 2 == 0, " prod ").otherwise(F.repeat(F.lit("e"), 65)).alias("environment")))
    return (
        _wire(e, key, "observation-upsert", "native", observation)
        .unionByName(_wire(e.where("event_type = 'purchase'"), key, "score-upsert", "native", score))
        .unionByName(_wire(e.where("event_type = 'signup'"), key, "trace-upsert", "native", body))
    )


@query("native_map", """SELECT 'o' || event_id AS id, 'u' || user_id AS trace_id, event_type AS name, epoch_us(ts) // 1000 * 1000 AS start_time, CASE event_type WHEN 'error' THEN 'error' ELSE 'default' END AS level, event_id % 50 AS input_tokens, event_id % 7 AS output_tokens FROM events WHERE event_id % 10 > 0""")
def native_map(spark, sf):
    o = native.observations(native_events(spark, sf))
    of = lambda k: F.try_element_at("usage_details", F.lit(k)).cast("long").alias(k)
    return o.select("id", "trace_id", "name", us("start_time"), "level", of("input_tokens"), of("output_tokens"))


@query("native_map_traces", "SELECT 't' || event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'prod' END AS environment, epoch_us(ts) // 1000 * 1000 AS timestamp FROM events WHERE event_type = 'signup'")
def native_map_traces(spark, sf):
    return native.traces(native_events(spark, sf)).select("id", "environment", us("timestamp"))


@query("native_map_scores", "SELECT 's' || event_id AS id, round(value, 2) AS value, 'numeric' AS data_type, epoch_us(TIMESTAMP '2024-06-01') AS timestamp FROM events WHERE event_type = 'purchase' AND event_id % 3 > 0")
def native_map_scores(spark, sf):
    return native.scores(native_events(spark, sf)).select("id", "value", "data_type", us("timestamp"))


@query("native_map_errors", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'traceId is missing or invalid' AS message FROM events WHERE event_id % 10 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), 'score requires value or stringValue' FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0")
def native_map_errors(spark, sf):
    return native.errors(native_events(spark, sf)).select("event_id", "message")


@query("raw_event_classes", "SELECT c AS class, count(*) AS events FROM (SELECT CASE WHEN event_id % 10 > 0 AND user_id = 7 THEN 'EXACT' ELSE 'NO' END AS c FROM events UNION ALL SELECT CASE WHEN user_id = 7 THEN 'EXACT' ELSE 'NO' END FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'NO' FROM events WHERE event_type = 'signup') GROUP BY ALL")
def raw_event_classes(spark, sf):
    return native_events(spark, sf).groupBy(raw.concerns(F.lit("u7")).alias("class")).agg(F.count("*").alias("events"))



def otlp_events(spark, sf) -> DataFrame:
    """An export per event: a root span, and a child that calls a model."""
    e = _events(spark, sf)
    key = F.col("event_id")
    nano = F.concat((F.unix_micros("ts") * 1000 + 999).cast("string"))
    attribute = lambda k, kind, v: F.concat(F.lit('{"key":"' + k + '","value":{"' + kind + '":'), v, F.lit("}}"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    span = lambda id_, more: F.concat(F.lit('{"traceId":"'), F.lit("t"), key, F.lit('","spanId":"'), F.lit(id_), key, F.lit('","name":"'), "event_type", F.lit('","startTimeUnixNano":"'), nano, F.lit('"'), more, F.lit("}"))
    root = span("r", F.concat(F.lit(',"attributes":['), attribute("user.id", "stringValue", quoted(F.col("user_id"))), F.lit("]")))
    kid = span("k", F.concat(
        F.lit(',"parentSpanId":"r'), key, F.lit('","status":{"code":'), F.when(F.col("event_type") == "error", "2").otherwise("1"), F.lit('},"attributes":['), attribute("gen_ai.request.model", "stringValue", quoted(F.concat(F.lit("m"), key % 9))), F.lit(","),
        attribute("gen_ai.usage.input_tokens", "intValue", quoted(key % 100)), F.lit(","), attribute("gen_ai.usage.cost", "doubleValue", F.round("value", 2).cast("string")), F.lit("]"),
    ))
    resource = F.concat(F.lit('{"attributes":['), attribute("deployment.environment", "stringValue", F.lit('"live"')), F.lit("]}"))
    body = F.concat(F.lit('{"resourceSpans":[{"resource":'), resource, F.lit(',"scopeSpans":[{"spans":['), kid, F.lit(","), root, F.lit("]}]}]}"))
    return _wire(e, key, "otlp-export", "otlp", body).withColumn("ordinal", F.col("id").cast("int"))


@query("otlp_flatten_map", """SELECT id || event_id AS id, 't' || event_id AS trace_id, CASE id WHEN 'k' THEN 'r' || event_id END AS parent_observation_id, CASE id WHEN 'k' THEN 'generation' ELSE 'span' END AS type, epoch_us(ts) // 1000 * 1000 AS start_time,
CASE WHEN id = 'k' AND event_type = 'error' THEN 'error' ELSE 'default' END AS level, CASE id WHEN 'k' THEN 'm' || (event_id % 9) END AS model, CASE id WHEN 'k' THEN event_id % 100 END AS input_tokens, CASE id WHEN 'k' THEN round(value, 2) END AS cost FROM events, (VALUES ('r'), ('k')) v(id)""")
def otlp_flatten_map(spark, sf):
    o = otlp.observations(otlp.spans(otlp_events(spark, sf)))
    return o.select("id", "trace_id", "parent_observation_id", "type", us("start_time"), "level", "model", F.try_element_at("usage_details", F.lit("input_tokens")).cast("long").alias("input_tokens"), F.try_element_at("cost_details", F.lit("total")).cast("double").alias("cost"))


@query("otlp_map_traces", "SELECT 't' || event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS user_id, 'live' AS environment FROM events")
def otlp_map_traces(spark, sf):
    return otlp.traces(otlp.spans(otlp_events(spark, sf))).select("id", "name", "user_id", "environment")


def compat_events(spark, sf) -> DataFrame:
    """A request per user: each event is an update and a create of one generation (in that order), purchases are
    scores, and every seventh generation names no trace."""
    e = _events(spark, sf)
    key = F.col("event_id")
    sent = T.to_iso(F.col("ts"))
    trace = F.when(key % 7 > 0, F.concat(F.lit("u"), "user_id"))
    create = F.to_json(F.struct(F.concat(F.lit("g"), key).alias("id"), trace.alias("traceId"), F.lit("first").alias("name"), F.lit("WARNING").alias("level"), F.struct((key % 30).alias("promptTokens"), F.lit(-1).alias("bad")).alias("usage")))
    update = F.to_json(F.struct(F.concat(F.lit(" g"), key).alias("id"), F.when(key % 2 == 0, F.lit("second")).alias("name"), F.concat(F.lit("m"), key % 5).alias("model")))
    score = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("u"), "user_id").alias("traceId"), F.lit("spent").alias("name"), F.round("value", 2).alias("value"))))
    item = lambda kind, suffix, body: F.struct(F.concat(key, F.lit(suffix)).alias("id"), sent.alias("timestamp"), F.lit(kind).alias("type"), body.alias("body"))
    items = F.filter(F.array(item("generation-update", "u", update), item("generation-create", "c", create), item("score-create", "s", score)), lambda i: i["body"].isNotNull())
    batch = e.select("user_id", "event_id", F.explode(items).alias("i")).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.length("i.id"), "i"))), lambda x: x["i"]).alias("batch"))
    return _wire(batch, F.col("user_id"), "langfuse-ingestion", "langfuse", F.to_json(F.struct("batch"))).withColumn("ordinal", F.col("id").cast("int"))


@query("langfuse_map", """SELECT 'g' || event_id AS id, 'u' || user_id AS trace_id, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'first' END AS name, 'warning' AS level, 'm' || (event_id % 5) AS model, 'generation' AS type, event_id % 30 AS input_tokens, epoch_us(ts) // 1000 * 1000 AS start_time FROM events WHERE event_id % 7 > 0""")
def langfuse_map(spark, sf):
    o = compat.observations(compat.events(compat_events(spark, sf)))
    return o.select("id", "trace_id", "name", "level", "model", "type", F.try_element_at("usage_details", F.lit("input_tokens")).cast("long").alias("input_tokens"), us("start_time"))


@query("langfuse_map_scores", "SELECT 's' || event_id AS id, 'u' || user_id AS trace_id, round(value, 2) AS value, 'numeric' AS data_type FROM events WHERE event_type = 'purchase'")
def langfuse_map_scores(spark, sf):
    return compat.scores(compat.events(compat_events(spark, sf))).select("id", "trace_id", "value", "data_type")


@query("langfuse_responses", "SELECT event_id || k AS event_id, CASE WHEN k <> 's' AND event_id % 7 = 0 THEN 400 ELSE 201 END AS status FROM events, (VALUES ('c'), ('u'), ('s')) v(k) WHERE k <> 's' OR event_type = 'purchase'")
def langfuse_responses(spark, sf):
    return compat.responses(compat.events(compat_events(spark, sf))).select("event_id", "status")


def _runs(spark, sf) -> DataFrame:
    """Lineitems as runs; the first line of an order is the root."""
    li = P._read(spark, sf, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    no = F.lit(None).cast("string")
    return li.select(
        F.concat(key, F.lit("-"), line).alias("id"), key.alias("trace_id"), F.when(line > 1, F.concat(key, F.lit("-1"))).alias("parent_run_id"), F.when(line % 2 == 0, "llm").otherwise("chain").alias("run_type"), F.concat(F.lit("run "), line).alias("name"),
        F.lit("2024-01-01T00:00:00Z").alias("start_time"), no.alias("end_time"), F.when(line == 7, "error").otherwise("success").alias("status"), no.alias("error"), no.alias("model"), no.alias("inputs"), no.alias("outputs"),
        line.cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.lit(None).cast("long").alias("total_tokens"), F.when(line == 3, "-1").when(line == 4, "oops").otherwise(F.concat(F.lit("0.00"), line)).alias("prompt_cost"),
        no.alias("completion_cost"), no.alias("total_cost"), F.array(F.lit("t")).alias("tags"), no.alias("session_id"),
    )


@query("import_langsmith", """SELECT DISTINCT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS trace_id, CASE WHEN l_linenumber > 1 THEN l_orderkey || '-1' END AS parent_observation_id, CASE WHEN l_linenumber % 2 = 0 THEN 'generation' ELSE 'span' END AS type,
CASE l_linenumber WHEN 7 THEN 'error' ELSE 'default' END AS level, CAST(l_linenumber AS BIGINT) AS input_tokens, CASE WHEN l_linenumber NOT IN (3, 4) THEN round(l_linenumber / 1000, 4) END AS cost FROM lineitem""")
def import_langsmith(spark, sf):
    _, o = importers.map_runs(_runs(spark, sf), "p")
    return o.select("id", "trace_id", "parent_observation_id", "type", "level", F.try_element_at("usage_details", F.lit("input_tokens")).cast("long").alias("input_tokens"), F.round(F.try_element_at("cost_details", F.lit("input")).cast("double"), 4).alias("cost"))


@query("import_langsmith_traces", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, 't,imported:langsmith' AS tags FROM lineitem WHERE l_linenumber = 1")
def import_langsmith_traces(spark, sf):
    traces, _ = importers.map_runs(_runs(spark, sf), "p")
    return traces.select("id", F.array_join("tags", ",").alias("tags"))


@query("import_feedback", "SELECT DISTINCT 'f' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey || '-' || l_linenumber END AS observation_id, CASE WHEN l_linenumber % 3 = 1 THEN 'numeric' ELSE 'categorical' END AS data_type FROM lineitem WHERE l_linenumber % 3 > 0")
def import_feedback(spark, sf):
    runs = _runs(spark, sf)
    line = F.split_part("id", F.lit("-"), F.lit(2)).cast("int")
    feedback = runs.select(F.concat(F.lit("f"), "id").alias("id"), F.col("id").alias("run_id"), F.lit("k").alias("key"), F.when(line % 3 == 1, 1.0).alias("score"), F.when(line % 3 == 2, "good").alias("value"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("string").alias("created_at"))
    return importers.map_feedback(feedback, runs, "p").select("id", "observation_id", "data_type")


@query("import_list_traces", "SELECT CAST(o_orderkey AS VARCHAR) AS id, epoch_us(o_orderdate::TIMESTAMP) AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS name, 'imported:langfuse' AS tags, o_orderstatus AS status FROM orders")
def import_list_traces(spark, sf):
    o = P._read(spark, sf, "orders")
    no = F.lit(None).cast("string")
    pulled = o.select(
        F.col("o_orderkey").cast("string").alias("id"), T.to_iso(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("name"), no.alias("userId"), no.alias("sessionId"), no.alias("environment"),
        no.alias("release"), no.alias("version"), F.array(F.lit("imported:langfuse")).alias("tags"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("metadata"), no.alias("input"), no.alias("output"),
    )
    return importers.map_list_traces(pulled, "p").select("id", us("timestamp"), "name", F.array_join("tags", ",").alias("tags"), F.col("metadata")["status"].alias("status"))


def _fixed_sql(value: str, digits: int) -> str:
    """Exact ties, which only these multiples can be, go up as they do here and not to the even digit."""
    tie = {0: 2, 1: 4, 2: 8, 4: 32}[digits]
    return f"printf('%.{digits}f', CASE WHEN ({value}) * {tie} = floor(({value}) * {tie}) THEN nextafter({value}, 'inf'::DOUBLE) ELSE {value} END)"


def _compact_sql(v: str) -> str:
    units = "".join(f" WHEN {v} >= {size} THEN CASE WHEN {v} / {size} < 100 THEN regexp_replace({_fixed_sql(f'{v} / {size}', 1)}, '\\.0$', '') ELSE {_fixed_sql(f'{v} / {size}', 0)} END || '{unit}'" for size, unit in (("1e9", "B"), ("1e6", "M"), ("1e3", "K")))
    return f"CASE WHEN {v} < 10000 THEN format('{{:,}}', {_fixed_sql(v, 0)}::BIGINT){units} END"


def _usd_sql(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN '$0.00' WHEN {v} < 0.01 THEN '<$0.01' WHEN {v} >= 1000 THEN '$' || {_compact_sql(v)} WHEN {v} < 1 THEN '$' || {_fixed_sql(v, 4)} ELSE '$' || {_fixed_sql(v, 2)} END"


@query("display_numbers", f"SELECT o_orderkey, {_compact_sql('v')} AS compact, {_usd_sql('v')} AS usd FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS v FROM orders)")
def display_numbers(spark, sf):
    price = F.col("o_totalprice").cast("double")
    return P._read(spark, sf, "orders").select("o_orderkey", display.compact_number(price).alias("compact"), display.usd(price).alias("usd"))


@query("display_texts", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE * l_quantity::DOUBLE * l_quantity::DOUBLE AS big, l_discount::DOUBLE * l_tax::DOUBLE / 8 AS small, CASE WHEN l_linenumber < 7 THEN l_extendedprice::DOUBLE * l_linenumber * l_linenumber / 8 END AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, {_compact_sql('big')} AS big, CASE WHEN small = 0 THEN '$0.00' WHEN small < 0.0001 THEN '<$0.0001' WHEN small < 1 THEN '$' || {_fixed_sql('small', 4)} ELSE {_usd_sql('small')} END AS cost, {_usd_sql('small')} AS usd,
CASE WHEN ms IS NULL THEN chr(8212) WHEN ms < 1000 THEN {_fixed_sql('ms', 0)} || 'ms' WHEN ms < 10000 THEN {_fixed_sql('ms / 1000', 2)} || 's' WHEN ms < 60000 THEN {_fixed_sql('ms / 1000', 1)} || 's' ELSE {_fixed_sql('ms / 60000', 1)} || 'm' END AS latency FROM v""")
def display_texts(spark, sf):
    of = lambda c: F.col(c).cast("double")
    line = F.col("l_linenumber")
    big, small, ms = of("l_extendedprice") * of("l_quantity") * of("l_quantity"), of("l_discount") * of("l_tax") / 8, F.when(line < 7, of("l_extendedprice") * line * line / 8)
    return P._read(spark, sf, "lineitem").select("l_orderkey", line, display.compact_number(big).alias("big"), display.trace_cost(small).alias("cost"), display.usd(small).alias("usd"), display.latency(ms).alias("latency"))


_ROLES_SQL = "role IN ('system', 'developer', 'user', 'assistant', 'tool', 'function') AND text IS NOT NULL"


@query("payload_turns", f"""SELECT conv_id, turn, CASE WHEN NOT coalesce({_ROLES_SQL}, FALSE) THEN 'json' WHEN turn % 2 = 0 THEN 'choices' ELSE 'messages' END AS kind, CASE WHEN {_ROLES_SQL} THEN role END AS role, CASE WHEN {_ROLES_SQL} AND turn % 2 = 0 THEN CAST(turn AS VARCHAR) END AS index,
CASE WHEN {_ROLES_SQL} THEN text END AS text FROM conversations""")
def payload_turns(spark, sf):
    """Every turn of the conversations as the payload of a request or of an answer, and read back from it."""
    turns = P._read(spark, sf, "conversations")
    message = F.struct("role", F.col("text").alias("content"))
    answer = F.struct(F.array(F.struct(F.col("turn").alias("index"), message.alias("message"))).alias("choices"))
    got = turns.withColumn("p", display.interpreted(F.when(F.col("turn") % 2 == 0, F.to_json(answer)).otherwise(F.to_json(message))))
    one = F.try_element_at("p.turns", F.lit(1))
    return got.select("conv_id", "turn", "p.kind", one["role"].alias("role"), one["index"].alias("index"), display.unwrapped(one["content"]).alias("text"))
