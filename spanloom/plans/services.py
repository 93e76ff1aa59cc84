"""What other programs read and send: compatible items, evaluator cursors, pulled rows, diagnostics, policies."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import pricing, text
from spanloom.functions import time as T
from spanloom.operators import evaluator, moved, paging, projects, retention, settlement, snapshots, versions
from spanloom.plans import feeds, ingest, upkeep
from spanloom.plans import projections as P
from spanloom.plans.lists import us
from spanloom.plans.projections import with_sql
from spanloom.sources import compat, export, importers
from spanloom.streaming import retention_log

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us({0}) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"


def _read_back(items: DataFrame, shape: str) -> DataFrame:
    """The items with ``i``, their fields as text by ``shape``; a text is parsed once for all fields."""
    return items.withColumn("i", F.from_json("item", shape))


def _names():
    return F.array_join(F.json_object_keys("item"), ",").alias("fields")


@query("compat_trace_items", f"""{with_sql('live_traces')} SELECT project_id, id, {ISO.format('timestamp')} AS timestamp, name, user_id, session_id, environment, release, tags[1] || '/' || tags[2] AS tags, status, third,
  'id,timestamp,name,userId,sessionId,environment,release,tags,metadata' AS fields FROM live_traces""")
def compat_trace_items(spark, sf):
    """Every field of a trace's item, and the names of the fields that are there."""
    live = versions.latest(P.ord_traces(spark, sf), "traces")
    shape = "id string, timestamp string, name string, userId string, sessionId string, environment string, release string, tags array<string>, metadata struct<status:string,third:string>"
    items = _read_back(live.select("project_id", "id", export.compat_item(live).alias("item")), shape)
    return items.select(
        "project_id", F.col("i.id").alias("id"), F.col("i.timestamp").alias("timestamp"), F.col("i.name").alias("name"), F.col("i.userId").alias("user_id"), F.col("i.sessionId").alias("session_id"),
        F.col("i.environment").alias("environment"), F.col("i.release").alias("release"), F.concat_ws("/", "i.tags").alias("tags"), F.col("i.metadata.status").alias("status"), F.col("i.metadata.third").alias("third"), _names(),
    )


@query("compat_observation_items", f"""{with_sql('live_obs')} SELECT project_id, trace_id, id, parent_observation_id AS parent, upper(type) AS type, upper(level) AS level, {ISO.format('start_time')} AS started, {ISO.format('end_time')} AS ended, model, name,
  tok_in AS input_tokens, CAST(cost_in AS DOUBLE) AS input_cost,
  array_to_string(list_filter(['id', 'traceId', CASE WHEN parent_observation_id IS NOT NULL THEN 'parentObservationId' END, 'type', 'name', 'startTime', CASE WHEN end_time IS NOT NULL THEN 'endTime' END, 'level', CASE WHEN model IS NOT NULL THEN 'model' END, 'metadata',
    CASE WHEN tok_in IS NOT NULL THEN 'usageDetails' END, CASE WHEN cost_in IS NOT NULL THEN 'costDetails' END], lambda x: x IS NOT NULL), ',') AS fields FROM live_obs""")
def compat_observation_items(spark, sf):
    live = versions.latest(P.ord_observations(spark, sf), "observations")
    shape = "traceId string, id string, parentObservationId string, type string, level string, startTime string, endTime string, model string, name string, usageDetails struct<input_tokens:string>, costDetails struct<input:string>"
    items = _read_back(live.select("project_id", export.compat_observation(live).alias("item")), shape)
    return items.select(
        "project_id", F.col("i.traceId").alias("trace_id"), F.col("i.id").alias("id"), F.col("i.parentObservationId").alias("parent"), F.col("i.type").alias("type"), F.col("i.level").alias("level"), F.col("i.startTime").alias("started"),
        F.col("i.endTime").alias("ended"), F.col("i.model").alias("model"), F.col("i.name").alias("name"), F.col("i.usageDetails.input_tokens").cast("long").alias("input_tokens"), F.col("i.costDetails.input").cast("double").alias("input_cost"), _names(),
    )


@query("compat_score_items", f"""{with_sql('evt_scores')} SELECT id, trace_id, observation_id, 'NUMERIC' AS data_type, 'API' AS source, value, {ISO.format('timestamp')} AS timestamp, 'id,traceId,observationId,name,dataType,value,source,timestamp' AS fields FROM evt_scores""")
def compat_score_items(spark, sf):
    rows = P.evt_scores(spark, sf)
    shape = "id string, traceId string, observationId string, dataType string, source string, value string, timestamp string"
    items = _read_back(rows.select(export.compat_score(rows).alias("item")), shape)
    return items.select(
        F.col("i.id").alias("id"), F.col("i.traceId").alias("trace_id"), F.col("i.observationId").alias("observation_id"), F.col("i.dataType").alias("data_type"), F.col("i.source").alias("source"),
        F.col("i.value").cast("double").alias("value"), F.col("i.timestamp").alias("timestamp"), _names(),
    )


@query("stored_turn_objects", f"""{with_sql('conv')} SELECT trace_id, id, name, parent_observation_id AS parent, coalesce(input, output) AS payload, {ISO.format('start_time')} AS started,
array_to_string(list_filter(['projectId', 'id', 'traceId', CASE WHEN parent_observation_id IS NOT NULL THEN 'parentObservationId' END, 'name', 'startTime', CASE WHEN input IS NOT NULL THEN 'input' END, CASE WHEN output IS NOT NULL THEN 'output' END], lambda x: x IS NOT NULL), ',') AS fields FROM conv""")
def stored_turn_objects(spark, sf):
    """Turns as objects; their texts stay text. One that reads as JSON is stored quoted, or its value would come."""
    kept = lambda c: F.when(text.parsed(F.col(c)).isNotNull(), F.to_json(F.col(c).cast("variant"))).otherwise(F.col(c)).alias(c)
    rows = P.conv_observations(spark, sf).select("project_id", "id", "trace_id", "parent_observation_id", "name", "start_time", kept("input"), kept("output"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    shape = "id string, traceId string, parentObservationId string, name string, startTime string, input string, output string"
    items = _read_back(rows.select(export.stored_object(rows).alias("item")), shape)
    return items.select(F.col("i.traceId").alias("trace_id"), F.col("i.id").alias("id"), F.col("i.name").alias("name"), F.col("i.parentObservationId").alias("parent"), F.coalesce(F.col("i.input"), F.col("i.output")).alias("payload"), F.col("i.startTime").alias("started"), _names())


@query("stored_event_objects", """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name, props ->> '$.k' AS k, epoch_us(ts) // 1000 AS started FROM events""")
def stored_event_objects(spark, sf):
    """Events as objects; their payload is JSON and comes as its value."""
    rows = P.evt_observations(spark, sf).drop("user_id", "value")
    shape = "id string, name string, startTime string, input struct<k:string>"
    items = _read_back(rows.select(export.stored_object(rows).alias("item")), shape)
    return items.select(F.col("i.id").alias("id"), F.col("i.name").alias("name"), F.col("i.input.k").alias("k"), F.unix_millis(F.to_timestamp(F.col("i.startTime"))).alias("started"))


@query("retention_keyset_page", f"""{upkeep.KEEP} SELECT project_id, id, epoch_us(timestamp) AS timestamp FROM live_traces JOIN limits USING (project_id)
WHERE timestamp < cutoff AND project_id = 'p1' AND (CAST(timestamp AS DATE), id) > (DATE '1994-01-01', '500') ORDER BY CAST(timestamp AS DATE), id LIMIT 201""")
def retention_keyset_page(spark, sf):
    """A project's rows past the cutoff, by day and id, from a key on: the order in which one deletes piece by piece."""
    due = retention.expired_rows(P.ord_traces(spark, sf), "traces", upkeep.limits(spark)).where("project_id = 'p1'").withColumn("day", F.to_date("timestamp"))
    return paging.keyset_page(due, ["day", "id"], 200, (date(1994, 1, 1), "500")).select("project_id", "id", us("timestamp"))


FROZEN = (datetime(2024, 1, 10), "u3")


@query("bootstrap_candidates", f"""{feeds.EVT}{feeds.ACTS} SELECT project_id, trace_id, epoch_us(version) AS version FROM clock c JOIN evt_traces t ON t.id = c.trace_id AND t.project_id = c.project_id
WHERE version <= {feeds.SETTLED_SQL} AND NOT EXISTS (FROM feed f WHERE f.project_id = c.project_id AND f.trace_id = c.trace_id AND (f.published_at, f.trace_id) > (TIMESTAMP '2024-01-10', 'u3'))""".replace("SELECT project_id, trace_id, epoch_us(version)", "SELECT c.project_id, c.trace_id, epoch_us(version)"))
def bootstrap_candidates(spark, sf):
    """Stored versions that a reader lists which found the feed at FROZEN; the others come to it by the feed."""
    feed = settlement.publish(feeds.activities(spark, sf))
    found = evaluator.candidates(*feeds._evt(spark, sf), feed, evaluator.Cursor("bootstrap", FROZEN, feeds.SETTLED), feeds.SETTLED)
    return found.select("project_id", "trace_id", us("version"))


@query("diagnostic_deletes", """WITH failed AS (SELECT 'p' || (user_id % 3) AS project_id, 'o' || user_id AS object_key, CAST(event_id AS VARCHAR) AS event_id, user_id, ts FROM events WHERE event_type = 'error'),
per AS (SELECT project_id, object_key, user_id, count(*) AS rows, count(DISTINCT event_id) AS held, max(ts) AS last FROM failed GROUP BY ALL)
SELECT project_id, object_key, rows, CASE WHEN user_id % 7 = 0 THEN 'sidecar_missing' WHEN user_id % 7 = 1 THEN 'sidecar_invalid' WHEN last >= TIMESTAMP '2024-01-25' THEN 'inside_window' WHEN user_id % 7 = 2 AND held > 1 THEN 'sets_differ' ELSE 'delete' END AS action FROM per""")
def diagnostic_deletes(spark, sf):
    """Failed events by object: of every seventh user's object no sidecar stands, of others one is broken or short."""
    e = ingest._events(spark, sf).where("event_type = 'error'").select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"), F.concat(F.lit("o"), "user_id").alias("object_key"), F.col("event_id").cast("string").alias("event_id"), "user_id", F.col("ts").alias("created_at"))
    no = F.col("user_id") % 7
    listed = e.groupBy("project_id", "object_key", "user_id").agg(F.sort_array(F.collect_set("event_id")).alias("events"))
    events = F.when((no == 2) & (F.size("events") > 1), F.slice("events", 2, F.size("events") - 1)).otherwise(F.col("events"))
    sidecars = listed.where(no > 0).select("project_id", "object_key", F.when(no == 1, "{broken").otherwise(F.to_json(F.struct(events.alias("events")))).alias("body"))
    return retention_log.diagnostics(e, sidecars, datetime(2024, 1, 25))


def client_requests(spark, sf) -> DataFrame:
    """A request an order: the trace with its tags and metadata, and for every second one an update with its session."""
    o = P._read(spark, sf, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    item = lambda no, body: F.struct(F.concat(F.col("key"), F.lit(no)).alias("id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("trace-create").alias("type"), F.to_json(body).alias("body"))
    first = item("a", F.struct(F.col("key").alias("id"), F.concat(F.lit("order "), "o_orderstatus").alias("name"), F.array("o_orderstatus").alias("tags"), F.struct(F.col("o_custkey").alias("customer")).alias("metadata"), T.to_iso(F.col("o_orderdate").cast("timestamp")).alias("timestamp")))
    second = item("b", F.struct(F.col("key").alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("sessionId"), F.concat(F.lit("renamed "), "key").alias("name")))
    batch = F.when(F.col("o_orderkey") % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    return compat.events(ingest._wire(o.withColumn("batch", batch), F.col("key"), "langfuse-ingestion", "langfuse", F.to_json(F.struct("batch"))))


@query("langfuse_map_traces", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'renamed ' || o_orderkey ELSE 'order ' || o_orderstatus END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_custkey % 40) END AS session_id,
o_orderstatus AS tags, CAST(o_custkey AS VARCHAR) AS customer, epoch_us(o_orderdate) AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN 'metadata,name,session_id,tags,timestamp' ELSE 'metadata,name,tags,timestamp' END AS provided FROM orders""")
def langfuse_map_traces(spark, sf):
    """Rows and the columns that were really sent."""
    t = compat.traces(client_requests(spark, sf))
    return t.select("id", "name", "session_id", F.array_join("tags", ",").alias("tags"), F.try_element_at("metadata", F.lit("customer")).alias("customer"), us("timestamp"), F.array_join(F.array_sort("provided"), ",").alias("provided"))


@query("import_list_scores", """SELECT 's' || event_id AS id, 'u' || user_id AS trace_id, CASE WHEN event_id % 4 > 0 THEN 'o' || event_id END AS observation_id, CASE event_id % 3 WHEN 0 THEN 'categorical' WHEN 1 THEN 'numeric' ELSE 'boolean' END AS data_type,
CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN event_type END AS string_value, CASE WHEN event_id % 2 = 0 THEN 'annotation' ELSE 'api' END AS source, epoch_us(ts) // 1000 * 1000 AS timestamp FROM events WHERE event_id % 5 > 0""")
def import_list_scores(spark, sf):
    """Events as pulled scores; every fifth holds neither a number nor text, and a third doesn't say its type."""
    e, key = ingest._events(spark, sf), F.col("event_id")
    pulled = e.select(
        F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("u"), "user_id").alias("traceId"), F.when(key % 4 > 0, F.concat(F.lit("o"), key)).otherwise("").alias("observationId"), F.lit("n").alias("name"),
        F.when(key % 3 == 2, "BOOLEAN").alias("dataType"), F.when((key % 5 > 0) & (key % 3 > 0), F.col("value")).alias("value"), F.when((key % 5 > 0) & (key % 3 == 0), F.col("event_type")).alias("stringValue"),
        F.when(key % 2 == 0, "ANNOTATION").otherwise("elsewhere").alias("source"), F.lit(None).cast("string").alias("comment"), T.to_iso(F.col("ts")).alias("timestamp"),
    )
    return importers.map_list_scores(pulled, "p").select("id", "trace_id", "observation_id", "data_type", "value", "string_value", "source", us("timestamp"))


@query("import_list_observations", """SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS trace_id, CASE WHEN l_linenumber % 2 = 0 THEN 'generation' ELSE 'span' END AS type, CASE l_returnflag WHEN 'R' THEN 'error' ELSE 'default' END AS level,
CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber < 5 THEN l_tax END AS input_cost, CASE WHEN l_linenumber BETWEEN 2 AND 4 AND l_discount >= 0 THEN l_discount END AS output_cost, CASE WHEN l_linenumber = 3 THEN 'pr' END AS prompt FROM lineitem""")
def import_list_observations(spark, sf):
    """Lineitems as pulled observations: the first line has cost details, lines to the fourth only the older fields."""
    li = P._read(spark, sf, "lineitem")
    line, older = F.col("l_linenumber"), F.col("l_linenumber").between(2, 4)
    pulled = li.select(
        F.concat("l_orderkey", F.lit("-"), line).alias("id"), F.col("l_orderkey").cast("string").alias("traceId"), F.lit("").alias("parentObservationId"), F.when(line % 2 == 0, "GENERATION").otherwise("strange").alias("type"), F.lit("n").alias("name"),
        F.lit("2024-01-01T00:00:00Z").alias("startTime"), F.lit(None).cast("string").alias("endTime"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("odd").alias("level"), F.lit("").alias("statusMessage"), F.lit("m").alias("model"),
        F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"), F.expr("cast(null as map<string,double>)").alias("usageDetails"), F.when(line == 1, F.create_map(F.lit("input"), F.col("l_quantity"))).alias("costDetails"),
        F.when(older, F.col("l_tax")).alias("calculatedInputCost"), F.when(older, F.col("l_discount")).alias("calculatedOutputCost"), F.lit(-1.0).alias("calculatedTotalCost"), F.when(line == 3, "pr").alias("promptName"), F.lit(None).cast("int").alias("promptVersion"), F.lit("{}").alias("metadata"),
    )
    cost = lambda k: F.try_element_at("cost_details", F.lit(k)).cast("double").alias(f"{k}_cost")
    return importers.map_list_observations(pulled, "p").select("id", "trace_id", "type", "level", cost("input"), cost("output"), F.try_element_at("metadata", F.lit("prompt_name")).alias("prompt"))


@query("derived_cost_merges", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS model, CASE WHEN p_partkey % 3 > 0 THEN CAST(CASE WHEN p_partkey % 3 = 1 THEN 7 ELSE 1 END AS DOUBLE) END AS total, p_partkey % 3 = 2 AS derived, 'v' AS kept FROM part""")
def derived_cost_merges(spark, sf):
    """Parts whose stored cost was derived from a price table: a third gets another model, which voids the cost, a
    third the client's own cost, which takes its place, and a third only a name."""
    part = P._read(spark, sf, "part").withColumn("kind", F.col("p_partkey") % 3)
    cost, meta = "map<string,decimal(18,9)>", "map<string,string>"
    none = lambda t: F.expr(f"cast(null as {t})")
    stored = part.select("p_partkey", F.lit("old").alias("model"), F.create_map(F.lit("total"), F.lit(1)).cast(cost).alias("cost_details"), F.create_map(F.lit(pricing.PROVENANCE[0]), F.lit("table"), F.lit("k"), F.lit("v")).alias("metadata"),
                         F.create_map(F.lit("input_tokens"), F.lit(5)).alias("usage_details"), none("map<string,timestamp>").alias("sent_at"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("event_ts"))
    sent = F.when(F.col("kind") == 0, F.array(F.lit("model"))).when(F.col("kind") == 1, F.array(F.lit("cost_details"))).otherwise(F.array().cast("array<string>"))
    incoming = part.select("p_partkey", F.when(F.col("kind") == 0, "new").alias("model"), F.when(F.col("kind") == 1, F.create_map(F.lit("total"), F.lit(7)).cast(cost)).alias("cost_details"), none(meta).alias("metadata"), none("map<string,int>").alias("usage_details"), sent.alias("provided"))
    fields = ["model", "cost_details", "metadata", "usage_details"]
    made = moved.by_recency(incoming, stored, ["p_partkey"], fields, F.to_timestamp(F.lit("2024-02-01 00:00:00"))).join(incoming.select("p_partkey", "provided"), "p_partkey")
    made = moved.consistent_cost(made)
    return made.select("p_partkey", "model", F.try_element_at("cost_details", F.lit("total")).cast("double").alias("total"), F.map_contains_key("metadata", F.lit(pricing.PROVENANCE[0])).alias("derived"), F.try_element_at("metadata", F.lit("k")).alias("kept"))


POLICIES = "policies AS (SELECT 'c' || c_custkey AS project_id, coalesce(CASE WHEN c_custkey % 5 > 0 THEN 30 + c_custkey % 900 END, 1200) AS days FROM customer)"


def policies(spark, sf) -> DataFrame:
    """A project a customer; every fifth leaves its retention to the default."""
    key = F.col("c_custkey")
    projects = P._read(spark, sf, "customer").select(F.concat(F.lit("c"), key).alias("project_id"), F.when(key % 5 > 0, (30 + key % 900).cast("int")).alias("retention_days"))
    return retention.cutoffs(projects, upkeep.NOW, 1200)


@query("retention_cutoffs", f"WITH {POLICIES} SELECT project_id, CAST(days AS INTEGER) AS days, epoch_us(TIMESTAMP '1998-06-01' - to_days(CAST(days AS INTEGER))) AS cutoff FROM policies")
def retention_cutoffs(spark, sf):
    return policies(spark, sf).select("project_id", "days", us("cutoff"))


@query("retention_floor", f"WITH {POLICIES} SELECT CAST(max(days) AS INTEGER) AS days, epoch_us(TIMESTAMP '1998-06-01' - to_days(CAST(max(days) AS INTEGER))) AS cutoff FROM policies")
def retention_floor(spark, sf):
    return retention.floor_days(policies(spark, sf)).select("days", us("cutoff"))


@query("price_overrides_ordered", "SELECT 'p' || (p_partkey % 4) AS project_id, CAST(row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey DESC) - 1 AS INTEGER) AS position, '^' || p_name AS pattern FROM part WHERE p_partkey % 9 > 0")
def price_overrides_ordered(spark, sf):
    """Rules named after parts, the newest first; every ninth isn't a pattern and takes no place."""
    p = P._read(spark, sf, "part")
    rules = p.select(F.concat(F.lit("p"), F.col("p_partkey") % 4).alias("project_id"), (-F.col("p_partkey")).alias("ordinal"), F.concat(F.when(F.col("p_partkey") % 9 == 0, "(").otherwise("^"), "p_name").alias("pattern"))
    return pricing.ordered_overrides(rules)


PROJECTS = """projects AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS organization_id, c_name AS name, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS created_at,
CASE WHEN c_custkey % 3 = 0 THEN 60 END AS quiet_seconds FROM customer)"""


def project_rows(spark, sf) -> DataFrame:
    """A project a customer, its nation the organization."""
    c, key = P._read(spark, sf, "customer"), F.col("c_custkey")
    created = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + key % 40 * 86_400_000_000)
    return c.select(F.concat(F.lit("c"), key).alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("organization_id"), F.col("c_name").alias("name"), created.alias("created_at"), F.when(key % 3 == 0, 60).alias("quiet_seconds"))


@query("projects_of_organization", f"WITH {PROJECTS} SELECT id, name, epoch_us(created_at) AS created_at FROM projects WHERE organization_id = 'n3'")
def projects_of_organization(spark, sf):
    return projects.of_organization(project_rows(spark, sf), "n3").select("id", "name", us("created_at"))


@query("projects_oldest", f"WITH {PROJECTS} SELECT id, organization_id, epoch_us(created_at) AS created_at FROM projects ORDER BY created_at, id LIMIT 21")
def projects_oldest(spark, sf):
    return projects.oldest(project_rows(spark, sf), 20).select("id", "organization_id", us("created_at"))


@query("projects_by_ids", f"WITH {PROJECTS} SELECT id, name FROM projects WHERE id IN (SELECT 'c' || o_custkey FROM orders)")
def projects_by_ids(spark, sf):
    """The projects that have orders."""
    asked = P._read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"))
    return projects.by_ids(project_rows(spark, sf), asked).select("id", "name")


@query("project_settlement", f"WITH {PROJECTS} SELECT id, epoch_us(TIMESTAMP '2024-06-01') - coalesce(quiet_seconds, 300) * 1000000 AS settled_before FROM projects")
def project_settlement(spark, sf):
    at = projects.settled_before(F.lit("2024-06-01").cast("timestamp"))
    return project_rows(spark, sf).select("id", F.unix_micros(at).alias("settled_before"))


_SNAPSHOT_SQL = """WITH runs AS (SELECT CAST(c_custkey AS VARCHAR) AS project_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'running' END AS status, 't' || c_nationkey AS run_token, CASE WHEN c_custkey % 9 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 7 AS INT)) END AS lease FROM customer),
state AS (SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS trace_id, o_orderstatus AS content_hash, CASE WHEN o_orderkey % 5 > 0 THEN substr(o_orderpriority, 1, 1) END AS tree_hash, 'a' || o_orderkey AS activity_id, o_orderdate::TIMESTAMP AS at, o_orderkey % 2 = 0 AS pending, o_orderkey % 4 < 2 AS publish_required FROM orders WHERE o_orderkey % 3 > 0),
live AS (SELECT * FROM runs WHERE status = 'running' AND lease > TIMESTAMP '2024-01-03')"""
_NOW = datetime(2024, 1, 3)


def _runs_and_state(spark, sf):
    """Runs by customer, and two thirds of the orders as staged traces."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    runs = P._read(spark, sf, "customer").select(
        key.cast("string").alias("project_id"), F.lit("s").alias("source"), F.when(key % 4 == 0, "failed").otherwise("running").alias("status"), F.concat(F.lit("t"), "c_nationkey").alias("run_token"),
        F.when(key % 9 > 0, F.timestamp_seconds(F.lit(1704067200) + key % 7 * 86400)).alias("lease_expires_at"),
    )
    orders = P._read(spark, sf, "orders")
    state = orders.where(order % 3 > 0).select(
        F.col("o_custkey").cast("string").alias("project_id"), F.lit("s").alias("source"), order.cast("string").alias("trace_id"), F.col("o_orderstatus").alias("content_hash"), F.when(order % 5 > 0, F.substring("o_orderpriority", 1, 1)).alias("tree_hash"),
        F.concat(F.lit("a"), order).alias("activity_id"), F.col("o_orderdate").cast("timestamp").alias("source_activity_at"), F.lit("{}").alias("snapshot"), F.lit("old").alias("run_token"), (order % 2 == 0).alias("pending"), (order % 4 < 2).alias("publish_required"),
        F.col("o_orderdate").cast("timestamp").alias("staged_at"),
    )
    return runs, state, orders


@query("staged_snapshots", _SNAPSHOT_SQL + """, pulled AS (SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS trace_id, CASE WHEN o_orderkey % 7 < 4 THEN o_orderstatus ELSE 'X' END AS content_hash, CASE WHEN o_orderkey % 11 < 5 THEN substr(o_orderpriority, 1, 1) END AS tree_hash, 't' || (o_orderkey % 25) AS run_token, TIMESTAMP '1995-01-01' AS at FROM orders)
SELECT p.trace_id, CASE WHEN s.content_hash = p.content_hash THEN s.activity_id ELSE 'new' END AS activity_id, epoch_us(CASE WHEN s.content_hash = p.content_hash THEN s.at WHEN s.at IS NOT NULL THEN greatest(p.at, s.at + INTERVAL 1 MILLISECOND) ELSE p.at END) AS at,
CASE WHEN s.content_hash = p.content_hash AND NOT s.pending THEN 'old' ELSE p.run_token END AS run_token, NOT coalesce(s.content_hash = p.content_hash AND NOT s.pending, FALSE) AS pending, CASE WHEN s.content_hash = p.content_hash THEN s.publish_required WHEN s.trace_id IS NOT NULL THEN s.tree_hash IS DISTINCT FROM p.tree_hash ELSE TRUE END AS publish_required
FROM pulled p JOIN live r ON r.project_id = p.project_id AND r.run_token = p.run_token LEFT JOIN state s ON s.project_id = p.project_id AND s.trace_id = p.trace_id""")
def staged_snapshots(spark, sf):
    runs, state, orders = _runs_and_state(spark, sf)
    order = F.col("o_orderkey")
    pulled = orders.select(
        F.col("o_custkey").cast("string").alias("project_id"), F.lit("s").alias("source"), order.cast("string").alias("trace_id"), F.concat(F.lit("t"), order % 25).alias("run_token"), F.lit(0).alias("ordinal"), F.when(order % 7 < 4, F.col("o_orderstatus")).otherwise("X").alias("content_hash"),
        F.when(order % 11 < 5, F.substring("o_orderpriority", 1, 1)).alias("tree_hash"), F.lit("new").alias("activity_id"), F.lit(datetime(1995, 1, 1)).alias("source_activity_at"), F.lit("{}").alias("snapshot"),
    )
    return snapshots.stage(state, pulled, runs, _NOW).select("trace_id", "activity_id", F.unix_micros("source_activity_at").alias("at"), "run_token", "pending", "publish_required")


@query("claimed_snapshots", _SNAPSHOT_SQL + " SELECT s.trace_id, r.run_token FROM state s JOIN live r ON r.project_id = s.project_id WHERE s.pending")
def claimed_snapshots(spark, sf):
    runs, state, _ = _runs_and_state(spark, sf)
    return snapshots.claim_pending(state, runs, _NOW).select("trace_id", "run_token")


@query("recovery_candidates", _SNAPSHOT_SQL + " SELECT DISTINCT s.project_id FROM state s JOIN runs r ON r.project_id = s.project_id WHERE s.pending AND (r.status <> 'running' OR r.lease IS NULL OR r.lease <= TIMESTAMP '2024-01-03')")
def recovery_candidates(spark, sf):
    runs, state, _ = _runs_and_state(spark, sf)
    return snapshots.recovery_candidates(state, runs, _NOW).select("project_id")


_SUMS = lambda kind: "count(*) FILTER (kind = '%s')" % kind + "".join(f" || ',' || coalesce(sum(CAST('0x' || substr(sha, {8 * i + 1}, 8) AS BIGINT)) FILTER (kind = '{kind}'), 0)" for i in range(8))


@query("snapshot_hashes", f"""WITH parts AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'score' ELSE 'observation' END AS kind, sha256('{{"id":' || l_linenumber || ',"part":' || l_partkey || '}}') AS sha FROM lineitem),
sums AS (SELECT l_orderkey, {_SUMS('observation')} AS o, {_SUMS('score')} AS s FROM parts GROUP BY 1),
told AS (SELECT o_orderkey, sha256('{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}') || ';' || coalesce(o, '0,0,0,0,0,0,0,0,0') AS tree, coalesce(s, '0,0,0,0,0,0,0,0,0') AS s FROM orders LEFT JOIN sums ON l_orderkey = o_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, sha256(tree || ';' || s) AS content_hash, sha256(tree) AS tree_hash FROM told""")
def snapshot_hashes(spark, sf):
    body = lambda *fields: F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields]))
    traces = P._read(spark, sf, "orders").select(F.lit("p").alias("project_id"), F.col("o_orderkey").cast("string").alias("trace_id"), body(("status", "o_orderstatus"), ("id", "o_orderkey")).alias("body"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "score").otherwise("observation")
    parts = P._read(spark, sf, "lineitem").select(F.lit("p").alias("project_id"), F.col("l_orderkey").cast("string").alias("trace_id"), kind.alias("kind"), body(("part", "l_partkey"), ("id", "l_linenumber")).alias("body"))
    return snapshots.content_hashes(traces, parts).drop("project_id")
