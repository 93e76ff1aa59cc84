"""The driver's tables as traces, observations and scores: in Spark, and the same as SQL text.

ORD: orders are traces and lineitems observations, whose repeats are versions. EVT: a user's day is a trace
and its events are observations; purchases are scores. CONV: conversations and their turns. DOC: documents
are traces and labels scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import utc

#: Milliseconds of 1995-01-01 and of a day.
BASE, DAY = 788_918_400_000, 86_400_000


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf}/{name}.parquet")


def ord_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Every 11th order has a second version, of which every other one deletes it; every 13th has a row on
    another day."""
    o = _read(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))

    def rows(df: DataFrame, days: int, hours: int, prefix: str, deleted, version: int) -> DataFrame:
        return df.select(
            F.concat(F.lit("p"), F.col("o_orderkey") % 4).alias("project_id"), F.col("o_orderkey").cast("string").alias("id"),
            (F.col("ts") + F.expr(f"INTERVAL {days} DAY")).alias("timestamp"), F.concat(F.lit(prefix), "o_orderstatus").alias("name"),
            F.col("o_custkey").cast("string").alias("user_id"), F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("session_id"),
            F.col("o_orderpriority").alias("environment"), F.concat(F.lit("r"), F.col("o_orderkey") % 3).alias("release"), F.lit(None).cast("string").alias("version"),
            F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("third"), (F.col("o_orderkey") % 3).cast("string")).alias("metadata"),
            F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"), (F.col("ts") + F.expr(f"INTERVAL {hours} HOUR")).alias("event_ts"),
            deleted.alias("is_deleted"), F.lit(version).cast("long").alias("seq"),
        )

    key = F.col("o_orderkey")
    return (
        rows(o, 0, 1, "order ", F.lit(False), 0)
        .unionByName(rows(o.where(key % 11 == 0), 0, 2, "changed ", key % 22 == 0, 1))
        .unionByName(rows(o.where(key % 13 == 0), 3, 3, "moved ", F.lit(False), 2))
    )


def ord_observations(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem")
    key, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    money = lambda c: F.col(c).cast("decimal(12,2)").cast("decimal(18,9)")
    count = lambda e: F.expr(e).cast("decimal(20,0)")
    start = F.lit(BASE) + key % 2000 * DAY + line.cast("long") * 60_000
    quantity = F.col("l_quantity").cast("long")
    usage = (
        F.when(line == 4, F.expr("cast(map() as map<string,decimal(20,0)>)"))
        .when(line == 5, F.create_map(F.lit("input_tokens"), count("cast(l_quantity as bigint)"), F.lit("output_tokens"), count("cast(l_quantity as bigint) * 2"), F.lit("total_tokens"), count("cast(l_quantity as bigint) * 4 + 1")))
        .otherwise(F.create_map(F.lit("input_tokens"), count("cast(l_quantity as bigint)"), F.lit("output_tokens"), count("cast(l_quantity as bigint) * 2")))
    )
    cost = (
        F.when(line == 4, F.expr("cast(map() as map<string,decimal(18,9)>)"))
        .when(line == 5, F.create_map(F.lit("input"), money("l_extendedprice"), F.lit("output"), money("l_tax"), F.lit("total"), money("l_discount")))
        .otherwise(F.create_map(F.lit("input"), money("l_extendedprice"), F.lit("output"), money("l_tax")))
    )
    return li.select(
        F.concat(F.lit("p"), key % 4).alias("project_id"), line.cast("string").alias("id"), key.cast("string").alias("trace_id"),
        F.when(line > 1, F.floor(line / 2).cast("string")).alias("parent_observation_id"), F.when(line % 2 == 0, "generation").otherwise("span").alias("type"),
        F.concat(F.lit("line "), line).alias("name"), F.timestamp_millis(start).alias("start_time"),
        F.when(line < 7, F.timestamp_millis(start + quantity * 1000 + part % 1000)).alias("end_time"),
        F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("default").alias("level"), F.lit(None).cast("string").alias("status_message"),
        F.when(line % 3 != 0, F.concat(F.lit("model-"), part % 20)).alias("model"), F.expr("cast(null as map<string,string>)").alias("model_parameters"),
        F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"), usage.alias("usage_details"), cost.alias("cost_details"),
        F.lit(None).cast("timestamp").alias("completion_start_time"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.col("l_shipdate").cast("timestamp").alias("event_ts"),
        ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")).alias("is_deleted"), (part * 1_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("seq"),
    )


def evt_traces(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_trunc("day", "ts")
    return e.groupBy("user_id", day.alias("day")).agg(F.min("ts").alias("timestamp"), F.max("ts").alias("event_ts")).select(
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"), F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("day", "yyyyMMdd")).alias("id"), "timestamp",
        F.lit("day").alias("name"), F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("env"), F.col("user_id") % 5).alias("environment"),
        F.array().cast("array<string>").alias("tags"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"),
        "event_ts", F.lit(False).alias("is_deleted"), F.lit(0).cast("long").alias("seq"),
    )


def evt_observations(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ended = F.when(F.col("event_type") != "view", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long") * 1000))
    return e.select(
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"), F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.lit(None).cast("string").alias("parent_observation_id"),
        F.lit("event").alias("type"), F.col("event_type").alias("name"), F.col("ts").alias("start_time"), ended.alias("end_time"),
        F.when(F.col("event_type") == "error", "error").otherwise("default").alias("level"), F.lit(None).cast("string").alias("model"), F.col("props").alias("input"), F.lit(None).cast("string").alias("output"),
        F.expr("cast(map() as map<string,decimal(20,0)>)").alias("usage_details"), F.expr("cast(map() as map<string,decimal(18,9)>)").alias("cost_details"),
        F.col("ts").alias("event_ts"), F.lit(False).alias("is_deleted"), F.col("event_id").alias("seq"), "user_id", "value",
    )


def evt_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = evt_observations(spark, sf).where("name = 'purchase'")
    return e.select(
        "project_id", F.concat(F.lit("s"), "id").alias("id"), "trace_id", F.col("id").alias("observation_id"), F.lit("spent").alias("name"), F.lit("numeric").alias("data_type"), "value",
        F.lit(None).cast("string").alias("string_value"), F.lit("api").alias("source"), F.when(F.col("user_id") % 2 == 0, "langsmith").alias("import_source"), F.col("start_time").alias("timestamp"), "event_ts", "is_deleted", "seq",
    )


def conv_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns; the first turn of each conversation is the root and others hang on the turn before."""
    c = _read(spark, sf, "conversations")
    start = F.timestamp_millis(F.lit(BASE) + F.col("conv_id") * DAY + F.col("turn") * 1000)
    return c.select(
        F.lit("p0").alias("project_id"), F.col("turn").cast("string").alias("id"), F.col("conv_id").cast("string").alias("trace_id"),
        F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_observation_id"), F.lit("span").alias("type"), F.col("role").alias("name"), start.alias("start_time"),
        F.lit(None).cast("timestamp").alias("end_time"), F.lit("default").alias("level"), F.lit(None).cast("string").alias("model"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("input"), F.when(F.col("role") == "assistant", F.col("text")).alias("output"),
        F.expr("cast(map() as map<string,decimal(20,0)>)").alias("usage_details"), F.expr("cast(map() as map<string,decimal(18,9)>)").alias("cost_details"),
        start.alias("event_ts"), F.lit(False).alias("is_deleted"), F.col("turn").alias("seq"),
    )


def conv_traces(spark: SparkSession, sf: str) -> DataFrame:
    return conv_observations(spark, sf).groupBy("project_id", F.col("trace_id").alias("id")).agg(F.min("start_time").alias("timestamp"), F.max("event_ts").alias("event_ts")).select(
        "project_id", "id", "timestamp", F.concat(F.lit("conversation "), "id").alias("name"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("environment"),
        F.array().cast("array<string>").alias("tags"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"),
        "event_ts", F.lit(False).alias("is_deleted"), F.lit(0).cast("long").alias("seq"),
    )


def doc_traces(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    ts = F.timestamp_millis(F.lit(BASE) + F.col("doc_id") * 60_000)
    return d.select(
        F.lit("p0").alias("project_id"), F.col("doc_id").cast("string").alias("id"), ts.alias("timestamp"), F.col("source").alias("name"), F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("environment"), F.array("lang", F.when(F.col("doc_id") % 7 == 0, "imported:langsmith").otherwise("native")).alias("tags"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.col("text").alias("input"), F.lit(None).cast("string").alias("output"), ts.alias("event_ts"), F.lit(False).alias("is_deleted"), F.col("doc_id").alias("seq"),
    )


def doc_scores(spark: SparkSession, sf: str) -> DataFrame:
    la = _read(spark, sf, "labels")
    ts = F.timestamp_millis(F.lit(BASE) + F.col("doc_id") * 60_000)
    base = la.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("name"), F.lit("numeric").alias("data_type"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("name"), F.lit("boolean").alias("data_type"), F.col("toxic").alias("v")))).alias("s"))
    return base.select(
        F.lit("p0").alias("project_id"), F.concat("s.name", F.lit("-"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("trace_id"), F.lit(None).cast("string").alias("observation_id"), "s.name", "s.data_type",
        F.col("s.v").cast("double").alias("value"), F.lit(None).cast("string").alias("string_value"), F.lit("annotation").alias("source"), F.lit(None).cast("string").alias("import_source"), ts.alias("timestamp"), ts.alias("event_ts"), F.lit(False).alias("is_deleted"), F.col("doc_id").alias("seq"),
    )


#: The same as SQL, one expression per projection, with the newest live versions.
SQL = {
    "ord_traces": """ord_traces AS (
  SELECT 'p' || (o_orderkey % 4) AS project_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderdate::TIMESTAMP + to_days(CAST(v.days AS INTEGER)) AS timestamp, v.prefix || o_orderstatus AS name,
    CAST(o_custkey AS VARCHAR) AS user_id, 's' || (o_custkey % 40) AS session_id, o_orderpriority AS environment, 'r' || (o_orderkey % 3) AS release, [o_orderstatus, o_orderpriority] AS tags,
    o_orderstatus AS status, CAST(o_orderkey % 3 AS VARCHAR) AS third, o_orderdate::TIMESTAMP + to_hours(v.hours) AS event_ts, v.seq = 1 AND o_orderkey % 22 = 0 AS is_deleted, CAST(v.seq AS BIGINT) AS seq
  FROM orders JOIN (VALUES (0, 1, 'order ', 0, 1), (0, 2, 'changed ', 1, 11), (3, 3, 'moved ', 2, 13)) v(days, hours, prefix, seq, every) ON o_orderkey % v.every = 0)""",
    "ord_observations": """ord_observations AS (
  SELECT 'p' || (l_orderkey % 4) AS project_id, CAST(l_linenumber AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS trace_id, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber // 2 AS VARCHAR) END AS parent_observation_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'generation' ELSE 'span' END AS type, 'line ' || l_linenumber AS name, epoch_ms(788918400000 + l_orderkey % 2000 * 86400000 + l_linenumber::BIGINT * 60000) AS start_time,
    CASE WHEN l_linenumber < 7 THEN epoch_ms(788918400000 + l_orderkey % 2000 * 86400000 + l_linenumber::BIGINT * 60000 + CAST(l_quantity AS BIGINT) * 1000 + l_partkey % 1000) END AS end_time,
    CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'default' END AS level, CASE WHEN l_linenumber % 3 <> 0 THEN 'model-' || (l_partkey % 20) END AS model,
    CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS BIGINT) END AS tok_in, CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS BIGINT) * 2 END AS tok_out, CASE WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) * 4 + 1 END AS tok_total,
    CASE WHEN l_linenumber <> 4 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS cost_in, CASE WHEN l_linenumber <> 4 THEN CAST(l_tax AS DECIMAL(12,2)) END AS cost_out, CASE WHEN l_linenumber = 5 THEN CAST(l_discount AS DECIMAL(12,2)) END AS cost_total,
    CASE WHEN l_linenumber <> 4 THEN coalesce(CASE WHEN l_linenumber = 5 THEN CAST(l_discount AS DECIMAL(12,2)) END, CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_tax AS DECIMAL(12,2))) END AS cost,
    CASE WHEN l_linenumber <> 4 THEN coalesce(CASE WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) * 4 + 1 END, CAST(l_quantity AS BIGINT) * 3) END AS tokens,
    l_shipdate::TIMESTAMP AS event_ts, l_linestatus = 'F' AND l_returnflag = 'N' AS is_deleted, l_partkey * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq
  FROM lineitem)""",
    "live_traces": """live_traces AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, CAST(timestamp AS DATE), id ORDER BY event_ts DESC, seq DESC) AS rn FROM ord_traces) WHERE rn = 1 AND NOT is_deleted)""",
    "live_obs": """live_obs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, CAST(start_time AS DATE), trace_id, id ORDER BY event_ts DESC, seq DESC) AS rn FROM ord_observations) WHERE rn = 1 AND NOT is_deleted)""",
    "metrics": """metrics AS (SELECT project_id, trace_id AS id, epoch_ms(max(end_time)) - epoch_ms(min(start_time)) AS duration_ms, sum(cost) AS total_cost, sum(tokens) AS total_tokens,
    count(*) FILTER (level = 'error') AS error_count, coalesce(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), []) AS models FROM live_obs GROUP BY ALL)""",
    "evt_observations": """evt_observations AS (
  SELECT 'p' || (user_id % 3) AS project_id, CAST(event_id AS VARCHAR) AS id, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_type AS name, ts::TIMESTAMP AS start_time,
    CASE WHEN event_type <> 'view' THEN make_timestamp(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000) END AS end_time, CASE WHEN event_type = 'error' THEN 'error' ELSE 'default' END AS level,
    props AS input, ts::TIMESTAMP AS event_ts, event_id AS seq, user_id, value FROM events)""",
    "evt_traces": """evt_traces AS (
  SELECT 'p' || (user_id % 3) AS project_id, 'u' || user_id || '-' || strftime(date_trunc('day', ts), '%Y%m%d') AS id, min(ts)::TIMESTAMP AS timestamp, 'day' AS name, CAST(user_id AS VARCHAR) AS user_id,
    'env' || (user_id % 5) AS environment, max(ts)::TIMESTAMP AS event_ts FROM events GROUP BY user_id, date_trunc('day', ts))""",
    "evt_scores": """evt_scores AS (SELECT project_id, 's' || id AS id, trace_id, id AS observation_id, value, CASE WHEN user_id % 2 = 0 THEN 'langsmith' END AS import_source, start_time AS timestamp, event_ts, seq FROM evt_observations WHERE name = 'purchase')""",
    "conv": """conv AS (SELECT 'p0' AS project_id, CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS trace_id, CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) END AS parent_observation_id, role AS name,
    epoch_ms(788918400000 + conv_id * 86400000 + turn * 1000) AS start_time, CASE WHEN role <> 'assistant' THEN text END AS input, CASE WHEN role = 'assistant' THEN text END AS output, turn FROM conversations)""",
    "docs": """docs AS (SELECT 'p0' AS project_id, CAST(doc_id AS VARCHAR) AS id, epoch_ms(788918400000 + doc_id * 60000) AS timestamp, source AS name, [lang, CASE WHEN doc_id % 7 = 0 THEN 'imported:langsmith' ELSE 'native' END] AS tags, text AS input, doc_id FROM documents)""",
    "doc_scores": """doc_scores AS (SELECT n || '-' || doc_id AS id, CAST(doc_id AS VARCHAR) AS trace_id, n AS name, CASE n WHEN 'quality' THEN 'numeric' ELSE 'boolean' END AS data_type, CAST(CASE n WHEN 'quality' THEN quality ELSE toxic END AS DOUBLE) AS value,
    epoch_ms(788918400000 + doc_id * 60000) AS timestamp FROM labels, (VALUES ('quality'), ('toxic')) t(n))""",
}
NEEDS = {"live_traces": ["ord_traces"], "live_obs": ["ord_observations"], "metrics": ["ord_observations", "live_obs"], "evt_scores": ["evt_observations"]}


def with_sql(*names: str) -> str:
    """The WITH clause of the named projections and what they build on; ends without a comma."""
    wanted: list[str] = []
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in wanted)
