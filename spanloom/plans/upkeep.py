"""Environments, retention, moved and merged rows, prices."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import pricing, usage
from spanloom.operators import environments, moved, retention, versions
from spanloom.plans import projections as P
from spanloom.plans.lists import us
from spanloom.plans.projections import with_sql

QUERIES: dict = {}
ORACLE: dict = {}

NOW = datetime(1998, 6, 1)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


ENVS = with_sql("live_traces") + ", stats AS (SELECT project_id, environment AS name, min(timestamp) AS first_seen_at, max(timestamp) AS last_seen_at FROM live_traces WHERE environment IS NOT NULL GROUP BY ALL)"
ENV_ROW = "project_id, name, epoch_us(first_seen_at) AS first_seen_at, epoch_us(last_seen_at) AS last_seen_at"


def _live(spark, sf) -> DataFrame:
    return versions.latest(P.ord_traces(spark, sf), "traces")


def _env_rows(df: DataFrame, *more) -> DataFrame:
    return df.select("project_id", "name", us("first_seen_at"), us("last_seen_at"), *more)


@query("environment_stats", f"{ENVS} SELECT {ENV_ROW} FROM stats")
def environment_stats(spark, sf):
    return _env_rows(environments.statistics(_live(spark, sf)))


REGISTRY = "(VALUES ('p0', '1-URGENT', TIMESTAMP '1990-01-01', TIMESTAMP '1991-01-01', true), ('p1', 'staging', TIMESTAMP '1990-01-01', TIMESTAMP '2020-01-01', false)) r(project_id, name, first_seen_at, last_seen_at, hidden)"


def registry(spark) -> DataFrame:
    rows = [("p0", "1-URGENT", datetime(1990, 1, 1), datetime(1991, 1, 1), True), ("p1", "staging", datetime(1990, 1, 1), datetime(2020, 1, 1), False)]
    return spark.createDataFrame(rows, "project_id string, name string, first_seen_at timestamp, last_seen_at timestamp, hidden boolean")


MERGED = f"{ENVS}, merged AS (SELECT project_id, name, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, bool_or(hidden) AS hidden FROM (FROM {REGISTRY} UNION ALL SELECT *, false FROM stats) GROUP BY ALL)"


@query("environment_merge", f"{MERGED} SELECT {ENV_ROW}, hidden FROM merged")
def environment_merge(spark, sf):
    return _env_rows(environments.merged(registry(spark), environments.statistics(_live(spark, sf))), "hidden")


@query("environment_listing", f"{MERGED} SELECT {ENV_ROW}, hidden FROM merged ORDER BY hidden, last_seen_at DESC, name, project_id LIMIT 7")
def environment_listing(spark, sf):
    merged_ = environments.merged(registry(spark), environments.statistics(_live(spark, sf)))
    return _env_rows(environments.listing(merged_).limit(7), "hidden")


@query("environment_registry_top", f"""{ENVS}, fresh AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_seen_at DESC, name) AS n FROM stats s WHERE NOT EXISTS (FROM {REGISTRY} WHERE r.project_id = s.project_id AND r.name = s.name))
SELECT {ENV_ROW} FROM (SELECT project_id, name, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM (SELECT project_id, name, first_seen_at, last_seen_at FROM {REGISTRY}
UNION ALL FROM stats s WHERE EXISTS (FROM {REGISTRY} WHERE r.project_id = s.project_id AND r.name = s.name)
UNION ALL SELECT * EXCLUDE (n) FROM fresh WHERE n <= 3 - CASE WHEN project_id IN ('p0', 'p1') THEN 1 ELSE 0 END) GROUP BY ALL)""")
def environment_registry_top(spark, sf):
    return _env_rows(environments.admitted(registry(spark), environments.statistics(_live(spark, sf)), 3))


@query("environment_rebuild", f"{ENVS} SELECT {ENV_ROW}, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_seen_at >= TIMESTAMP '2002-06-01' DESC, last_seen_at DESC, name) AS n FROM stats) WHERE n <= 4")
def environment_rebuild(spark, sf):
    return _env_rows(environments.rebuilt(_live(spark, sf), datetime(2002, 6, 1), 4), F.col("place").cast("long").alias("place"))


@query("environment_keyset_page", f"{with_sql('live_traces')} SELECT project_id, environment, epoch_us(timestamp) AS timestamp, id FROM live_traces WHERE environment IS NOT NULL AND (timestamp, id) > (TIMESTAMP '1996-01-01', '') ORDER BY timestamp, id LIMIT 41")
def environment_keyset_page(spark, sf):
    return environments.named_page(_live(spark, sf), 40, (datetime(1996, 1, 1), "")).select("project_id", "environment", us("timestamp"), "id")


@query("candidate_cap", f"{with_sql('live_traces')} SELECT least(count(DISTINCT user_id), 101) AS names FROM live_traces")
def candidate_cap(spark, sf):
    return _live(spark, sf).select("user_id").distinct().limit(environments.CAPACITY + 1).agg(F.count("*").alias("names"))


# Retention: projects keep 400, 800 and (by default) 1,200 days; p3 is unknown to the policy table.
LIMITS = """limits AS (SELECT project_id, coalesce(d, 1200) AS days, TIMESTAMP '1998-06-01' - to_days(CAST(coalesce(d, 1200) AS INTEGER)) AS cutoff FROM (VALUES ('p0', 400), ('p1', 800), ('p2', NULL)) p(project_id, d))"""
KEEP = with_sql("live_traces", "live_obs") + f""", {LIMITS},
retained AS (SELECT DISTINCT project_id, id AS trace_id FROM live_traces JOIN limits USING (project_id) WHERE timestamp >= cutoff),
due AS (SELECT o.* FROM live_obs o JOIN limits USING (project_id) WHERE start_time < cutoff)"""


def projects(spark) -> DataFrame:
    return spark.createDataFrame([("p0", 400), ("p1", 800), ("p2", None)], "project_id string, retention_days int")


def limits(spark) -> DataFrame:
    return retention.cutoffs(projects(spark), NOW, 1200)


def _ord(spark, sf):
    return P.ord_traces(spark, sf), P.ord_observations(spark, sf)


@query("retention_row_deletes", f"{KEEP} SELECT project_id, id, epoch_us(timestamp) AS timestamp FROM live_traces JOIN limits USING (project_id) WHERE timestamp < cutoff")
def retention_row_deletes(spark, sf):
    return retention.expired_rows(P.ord_traces(spark, sf), "traces", limits(spark)).select("project_id", "id", us("timestamp"))


@query("retention_children_exempt", f"{KEEP} SELECT project_id, trace_id, id FROM due d WHERE NOT EXISTS (FROM retained r WHERE r.project_id = d.project_id AND r.trace_id = d.trace_id)")
def retention_children_exempt(spark, sf):
    traces, observations = _ord(spark, sf)
    return retention.child_deletes(observations, "observations", traces, limits(spark)).select("project_id", "trace_id", "id")


@query("retention_expired_parents", f"{KEEP} SELECT DISTINCT project_id, id AS trace_id FROM live_traces JOIN limits USING (project_id) WHERE timestamp < cutoff")
def retention_expired_parents(spark, sf):
    return retention.expired_parents(P.ord_traces(spark, sf), limits(spark))


@query("retention_orphan_children", f"{KEEP} SELECT project_id, trace_id, id FROM live_obs o WHERE CAST(trace_id AS BIGINT) % 22 = 0 AND NOT EXISTS (FROM live_traces t WHERE t.project_id = o.project_id AND t.id = o.trace_id)")
def retention_orphan_children(spark, sf):
    traces, observations = _ord(spark, sf)
    recorded = traces.where(F.col("id").cast("long") % 22 == 0).select("project_id", F.col("id").alias("trace_id")).distinct()
    return retention.orphans(observations, "observations", recorded, traces).select("project_id", "trace_id", "id")


@query("retention_droppable_months", with_sql("ord_traces") + " SELECT month FROM (SELECT strftime(timestamp, '%Y-%m') AS month, max(timestamp) AS last FROM ord_traces GROUP BY ALL) WHERE last < TIMESTAMP '1996-05-01' - INTERVAL 24 HOUR")
def retention_droppable_months(spark, sf):
    return retention.droppable_months(P.ord_traces(spark, sf), "traces", F.lit(datetime(1996, 5, 1)).cast("timestamp"))


@query("retention_held_months", f"""{KEEP} SELECT month FROM (SELECT strftime(start_time, '%Y-%m') AS month, max(start_time) AS last FROM ord_observations GROUP BY ALL) m WHERE last < TIMESTAMP '1996-05-01' - INTERVAL 24 HOUR
AND NOT EXISTS (FROM ord_observations o JOIN retained r USING (project_id, trace_id) WHERE strftime(o.start_time, '%Y-%m') = m.month)""")
def retention_held_months(spark, sf):
    traces, observations = _ord(spark, sf)
    parents = retention.retained_parents(traces, limits(spark))
    return retention.droppable_months(observations, "observations", F.lit(datetime(1996, 5, 1)).cast("timestamp"), parents)


@query("lifecycle_candidates", f"{KEEP} SELECT project_id, (SELECT count(*) FROM live_traces t WHERE t.project_id = l.project_id AND timestamp < cutoff) AS traces, (SELECT count(*) FROM due d WHERE d.project_id = l.project_id) AS observations FROM limits l")
def lifecycle_candidates(spark, sf):
    traces, observations = _ord(spark, sf)
    return retention.candidate_counts({"traces": traces, "observations": observations}, limits(spark))


@query("lifecycle_zero_filled", f"{with_sql('live_traces')} SELECT p AS project_id, (SELECT count(*) FROM live_traces t WHERE t.project_id = p AND timestamp < TIMESTAMP '1998-06-01' - INTERVAL 1200 DAY) AS traces FROM (VALUES ('p0'), ('none')) v(p)")
def lifecycle_zero_filled(spark, sf):
    P.utc(spark)
    asked = spark.createDataFrame([("p0", None), ("none", None)], "project_id string, retention_days int")
    return retention.candidate_counts({"traces": P.ord_traces(spark, sf)}, retention.cutoffs(asked, NOW, 1200))


@query("feed_orphans", f"{with_sql('live_traces')} SELECT DISTINCT 'p' || (l_orderkey % 4) AS project_id, CAST(l_orderkey AS VARCHAR) AS trace_id FROM lineitem WHERE NOT EXISTS (FROM live_traces t WHERE t.id = CAST(l_orderkey AS VARCHAR))")
def feed_orphans(spark, sf):
    traces, observations = _ord(spark, sf)
    return retention.feed_orphans(observations.select("project_id", "trace_id").distinct(), traces)


@query("visible_trace_ids", f"{with_sql('live_traces', 'live_obs', 'evt_scores')} SELECT project_id, id AS trace_id FROM live_traces UNION SELECT project_id, trace_id FROM live_obs UNION SELECT project_id, trace_id FROM evt_scores")
def visible_trace_ids(spark, sf):
    from spanloom.operators import refs

    traces, observations = _ord(spark, sf)
    return refs.visible(versions.latest(traces, "traces"), versions.latest(observations, "observations"), P.evt_scores(spark, sf))


@query("provenance_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY")
def provenance_purge(spark, sf):
    e = P._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return retention.purge(e, "ts", datetime(2024, 2, 10)).select("event_id")


@query("failures_newest", "SELECT event_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def failures_newest(spark, sf):
    e = P._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type = 'error'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", us("ts"))


# Imports
AT = datetime(2003, 1, 1)
SNAP = with_sql("live_traces") + ", stored AS (SELECT * FROM live_traces WHERE project_id = 'p3')"


@query("import_snapshot_replace", f"{SNAP} SELECT id, epoch_us(TIMESTAMP '2003-01-01') - 1 AS event_ts, true AS is_deleted FROM stored UNION ALL SELECT id, epoch_us(TIMESTAMP '2003-01-01'), false FROM stored WHERE CAST(id AS BIGINT) % 3 = 0")
def import_snapshot_replace(spark, sf):
    stored = P.ord_traces(spark, sf).where("project_id = 'p3'")
    fresh = versions.latest(stored, "traces").where(F.col("id").cast("long") % 3 == 0)
    return versions.replace_snapshot(stored, fresh, AT, "traces").select("id", us("event_ts"), "is_deleted")


@query("import_snapshot_result", f"{SNAP} SELECT id, name FROM stored WHERE CAST(id AS BIGINT) % 3 = 0")
def import_snapshot_result(spark, sf):
    stored = P.ord_traces(spark, sf).where("project_id = 'p3'")
    fresh = versions.latest(stored, "traces").where(F.col("id").cast("long") % 3 == 0)
    return versions.latest(stored.unionByName(versions.replace_snapshot(stored, fresh, AT, "traces")), "traces").select("id", "name")


@query("import_expired", f"{SNAP} SELECT id, epoch_us(TIMESTAMP '2003-01-01') + 1 AS event_ts, true AS is_deleted FROM stored")
def import_expired(spark, sf):
    return versions.expire_snapshot(P.ord_traces(spark, sf).where("project_id = 'p3'"), AT, "traces").select("id", us("event_ts"), "is_deleted")


@query("import_scores_replace", f"""{with_sql('evt_scores')} SELECT id, epoch_us(TIMESTAMP '2003-01-01') - 1 AS event_ts, true AS is_deleted, value FROM evt_scores WHERE import_source = 'langsmith'
UNION ALL SELECT id, epoch_us(TIMESTAMP '2003-01-01'), false, value + 1 FROM evt_scores WHERE import_source = 'langsmith' AND value > 50""")
def import_scores_replace(spark, sf):
    """A later import holds a part of the scores, with other values."""
    stored = P.evt_scores(spark, sf)
    fresh = stored.where("import_source = 'langsmith' AND value > 50").withColumn("value", F.col("value") + 1)
    return versions.replace_scores(stored, fresh, "langsmith", AT).select("id", us("event_ts"), "is_deleted", "value")


@query("import_identity_check", f"{with_sql('evt_observations', 'evt_traces')} SELECT trace_id, id FROM evt_observations o WHERE EXISTS (FROM evt_traces t WHERE t.project_id = o.project_id AND t.id = o.trace_id AND t.user_id = '9')")
def import_identity_check(spark, sf):
    from spanloom.sources.importers import own_children

    traces = P.evt_traces(spark, sf).where("user_id = '9'")
    return own_children(traces, P.evt_observations(spark, sf)).select("trace_id", "id")


@query("batch_entities", f"{with_sql('ord_observations')} SELECT DISTINCT kind, id FROM (SELECT 'trace' AS kind, trace_id AS id FROM ord_observations UNION ALL SELECT 'observation', trace_id || '/' || id FROM ord_observations)")
def batch_entities(spark, sf):
    o = P.ord_observations(spark, sf)
    return o.select(F.lit("trace").alias("kind"), F.col("trace_id").alias("id")).union(o.select(F.lit("observation"), F.concat("trace_id", F.lit("/"), "id"))).distinct()


# Moved and merged rows
BATCH = with_sql("live_traces") + """, batch AS (SELECT 'trace' AS kind, project_id, '' AS trace_id, id, timestamp + INTERVAL 1 DAY AS sort_time, CAST(seq AS BIGINT) AS ordinal FROM ord_traces WHERE CAST(id AS BIGINT) % 5 = 0),
mine AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY ordinal DESC) AS n FROM batch) WHERE n = 1),
stored AS (SELECT project_id, id, timestamp AS sort_time, event_ts FROM live_traces),
newer AS (SELECT DISTINCT project_id, id FROM stored WHERE event_ts > TIMESTAMP '1998-01-01')"""


def _moved(spark, sf):
    t = P.ord_traces(spark, sf)
    keyed = lambda d: d.select(F.lit("trace").alias("kind"), "project_id", F.lit("").alias("trace_id"), "id", F.col("timestamp").alias("sort_time"), "event_ts", F.col("seq").alias("ordinal"))
    batch = keyed(t.where(F.col("id").cast("long") % 5 == 0)).withColumn("sort_time", F.col("sort_time") + F.expr("INTERVAL 1 DAY")).drop("event_ts")
    return moved.resolve(batch, keyed(versions.latest(t, "traces")).drop("ordinal"), datetime(1998, 1, 1))


@query("batch_last_row", f"{BATCH} SELECT project_id, id, epoch_us(sort_time) AS sort_time FROM mine m WHERE NOT EXISTS (FROM newer n WHERE n.project_id = m.project_id AND n.id = m.id)")
def batch_last_row(spark, sf):
    """Rows of a batch that are written: each record's last, unless a newer one is stored."""
    return _moved(spark, sf)[0].select("project_id", "id", us("sort_time"))


@query("moved_rows_resolution", f"""{BATCH} SELECT s.project_id, s.id, epoch_us(s.sort_time) AS sort_time FROM stored s JOIN mine m ON m.project_id = s.project_id AND m.id = s.id
WHERE CASE WHEN EXISTS (FROM newer n WHERE n.project_id = s.project_id AND n.id = s.id) THEN s.event_ts < TIMESTAMP '1998-01-01' ELSE CAST(s.sort_time AS DATE) <> CAST(m.sort_time AS DATE) AND s.event_ts <= TIMESTAMP '1998-01-01' END""")
def moved_rows_resolution(spark, sf):
    return _moved(spark, sf)[1].select("project_id", "id", us("sort_time"))


@query("create_update_merge", """SELECT CAST(l_orderkey AS VARCHAR) AS id, arg_max(model, o) FILTER (model IS NOT NULL) AS model, arg_max(level, o) FILTER (level IS NOT NULL) AS level, arg_max(mode, o) AS mode FROM (
SELECT l_orderkey, row(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS o, CASE WHEN l_linenumber % 2 = 0 THEN 'm' || (l_partkey % 9) END AS model, CASE WHEN l_quantity > 10 THEN l_linestatus END AS level, l_returnflag AS mode FROM lineitem) GROUP BY ALL""")
def create_update_merge(spark, sf):
    """Creates first, then updates; a null never erases."""
    li = P._read(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("update"), "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice",
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("m"), F.col("l_partkey") % 9)).alias("model"), F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).alias("level"), F.col("l_returnflag").alias("mode"),
    )
    return moved.fold_fields(rows, ["id"], ["model", "level", "mode"], ["update", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice"])


@query("field_recency_merge", """WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END AS model, o_orderdate AS event_ts, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN TIMESTAMP '2010-01-01' END AS name_at, o_orderkey % 4 < 2 AS kept_times FROM orders),
t AS (SELECT *, CASE WHEN kept_times THEN name_at ELSE CASE WHEN name IS NOT NULL THEN event_ts END END AS stored_name_at, CASE WHEN kept_times THEN NULL ELSE CASE WHEN model IS NOT NULL THEN event_ts END END AS stored_model_at, id % 5 = 0 AS sends_model FROM s)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN stored_name_at IS NULL OR TIMESTAMP '1998-01-01' >= stored_name_at THEN 'new' ELSE name END AS name,
CASE WHEN sends_model AND (stored_model_at IS NULL OR TIMESTAMP '1998-01-01' >= stored_model_at) THEN 'fresh' WHEN stored_model_at IS NOT NULL OR model IS NOT NULL THEN model ELSE 'fresh' END AS model FROM t""")
def field_recency_merge(spark, sf):
    o = P._read(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    times = F.when(key % 4 == 0, F.create_map(F.lit("name"), "ts")).when(key % 4 == 1, F.create_map(F.lit("name"), F.lit(datetime(2010, 1, 1)).cast("timestamp")))
    stored = o.select(key.cast("string").alias("id"), F.col("o_orderstatus").alias("name"), F.when(key % 3 == 0, "old").alias("model"), F.col("ts").alias("event_ts"), times.alias("sent_at"))
    sent = F.when(key % 5 == 0, F.array(F.lit("name"), F.lit("model"))).otherwise(F.array(F.lit("name")))
    incoming = o.select(key.cast("string").alias("id"), F.lit("new").alias("name"), F.lit("fresh").alias("model"), sent.alias("provided"))
    return moved.by_recency(incoming, stored, ["id"], ["name", "model"], F.lit(datetime(1998, 1, 1)).cast("timestamp")).select("id", "name", "model")


# Prices: models are part names behind a provider, with a date or "latest"
PRICE_ROWS = [("small ring", "0.000003", "0.000015", "0.0000003", None), ("openai/red widget", "0.00001", None, None, None), ("blue bolt", None, "0.00002", None, "0.000001")]
OVERRIDE_ROWS = [("p1", 2, "WIDGET$", "0.5", None, None, None), ("p1", 1, "^red", "0.25", "0.125", None, None), ("p1", 0, "(", "9", None, None, None)]
COSTS = "input string, output string, cache_read string, cache_write string"


def prices(spark) -> DataFrame:
    P.utc(spark)
    df = spark.createDataFrame(PRICE_ROWS, f"model string, {COSTS}")
    return df.select("model", *[F.col(c).cast("decimal(24,15)").alias(c) for c in pricing.COMPONENTS], F.lit("2026-01-01").alias("synced_at"))


def overrides(spark) -> DataFrame:
    df = spark.createDataFrame(pricing.usable_overrides(OVERRIDE_ROWS), f"project_id string, position int, pattern string, {COSTS}")
    return df.select("project_id", "position", "pattern", *[F.col(c).cast("decimal(24,15)").alias(c) for c in pricing.COMPONENTS])


MODEL_SQL = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'OpenAI/' || p_name || '-2024-05-01' WHEN 2 THEN 'x/' || upper(p_name) || ':latest' ELSE p_name || '@20240501' END"
PARTS = f"""WITH parts AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'p1' ELSE 'p0' END AS project_id, {MODEL_SQL} AS model, p_size AS tokens FROM part),
named AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(model), '^[^/]*/', ''), '[-@]([0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$', ''), '[-:]latest$', '') AS bare FROM parts),
priced AS (SELECT *, CASE WHEN project_id = 'p1' AND regexp_matches(model, '^red', 'i') THEN '^red' WHEN project_id = 'p1' AND regexp_matches(model, 'WIDGET$', 'i') THEN 'WIDGET$' WHEN bare = 'small ring' THEN 'small ring' WHEN bare = 'red widget' THEN 'openai/red widget' WHEN bare = 'blue bolt' THEN 'blue bolt' END AS matched FROM named)"""


def parts(spark, sf) -> DataFrame:
    p = P._read(spark, sf, "part")
    key, name = F.col("p_partkey") % 4, F.col("p_name")
    model = F.when(key == 0, name).when(key == 1, F.concat(F.lit("OpenAI/"), name, F.lit("-2024-05-01"))).when(key == 2, F.concat(F.lit("x/"), F.upper(name), F.lit(":latest"))).otherwise(F.concat(name, F.lit("@20240501")))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "p1").otherwise("p0").alias("project_id"), model.alias("model"), F.col("p_size").alias("tokens"))


PROVIDERS_SQL = ", ".join(f"'{p}'" for p in pricing.PROVIDERS)


@query("model_candidates", f"""SELECT p_partkey, array_to_string(list_concat(['openai/' || upper(p_name) || '-20240501', 'openai/' || p_name || '-20240501', p_name || '-20240501', 'openai/' || p_name, p_name],
flatten(list_transform(list_filter([{PROVIDERS_SQL}], lambda p: p <> 'openai'), lambda p: [p || '/' || p_name || '-20240501', p || '/' || p_name]))), '|') AS names FROM part""")
def model_candidates(spark, sf):
    """All candidates in order: as written, in lower case, without provider and date, then behind each other provider."""
    found = pricing.candidates(F.concat(F.lit("openai/"), F.upper("p_name"), F.lit("-20240501")))
    # the file is small and the names of a row are dear: rows go out to all cores before any is made
    part = P._read(spark, sf, "part").select("p_partkey", "p_name").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select("p_partkey", F.array_join(found, "|").alias("names"))


@query("price_override_first_match", f"{PARTS} SELECT DISTINCT project_id, model, CASE WHEN matched IN ('^red', 'WIDGET$') THEN 'override' ELSE 'table' END AS source, matched FROM priced WHERE matched IS NOT NULL")
def price_override_first_match(spark, sf):
    return pricing.resolve(parts(spark, sf), overrides(spark), prices(spark)).select("project_id", "model", "source", "matched")


@query("cost_enriched", f"""{PARTS}, amounts AS (SELECT p_partkey, matched, tokens * CASE matched WHEN '^red' THEN 0.25 WHEN 'WIDGET$' THEN 0.5 WHEN 'small ring' THEN 0.000003 WHEN 'openai/red widget' THEN 0.00001 END AS i,
  2 * tokens * CASE matched WHEN '^red' THEN 0.125 WHEN 'small ring' THEN 0.000015 WHEN 'blue bolt' THEN 0.00002 END AS o FROM priced)
SELECT p_partkey, round(CAST(i AS DOUBLE), 9) AS input, round(CAST(o AS DOUBLE), 9) AS output, CASE WHEN coalesce(i, o) IS NOT NULL THEN round(CAST(coalesce(i, 0) + coalesce(o, 0) AS DOUBLE), 9) END AS total, CASE WHEN coalesce(i, o) IS NOT NULL THEN matched END AS matched FROM amounts""")
def cost_enriched(spark, sf):
    made = parts(spark, sf).withColumns({
        "usage_details": F.create_map(F.lit("input_tokens"), F.col("tokens").cast("decimal(20,0)"), F.lit("output_tokens"), (F.col("tokens") * 2).cast("decimal(20,0)")),
        "cost_details": F.expr("cast(map() as map<string,decimal(18,9)>)"), "metadata": F.expr("cast(map() as map<string,string>)"),
    })
    out = pricing.enrich(made, overrides(spark), prices(spark))
    cost = lambda k: F.round(F.try_element_at("cost_details", F.lit(k)).cast("double"), 9).alias(k)
    return out.select("p_partkey", cost("input"), cost("output"), cost("total"), F.try_element_at("metadata", F.lit(pricing.PROVENANCE[1])).alias("matched"))


@query("usage_canonical", """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) + 1 END AS input_tokens, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS output_tokens, CASE WHEN l_linenumber = 3 THEN NULL ELSE 7 END AS cached FROM lineitem""")
def usage_canonical(spark, sf):
    """A canonical key beats its aliases, of two aliases the first counts, counts are rounded and negative ones dropped."""
    li = P._read(spark, sf, "lineitem")
    q = F.col("l_quantity")
    sent = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("input"), q + 5, F.lit("input_tokens"), q, F.lit("completionTokens"), F.col("l_extendedprice"), F.lit("cached"), F.lit(7.0)))
    sent = sent.otherwise(F.create_map(F.lit("promptTokens"), q + 1, F.lit("input"), q, F.lit("completion_tokens"), F.col("l_extendedprice"), F.lit("cached"), F.when(F.col("l_linenumber") == 3, -1.0).otherwise(7.0)))
    found = usage.counts(sent)
    of = lambda k: F.try_element_at(found, F.lit(k)).cast("long").alias(k)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), of("input_tokens"), of("output_tokens"), of("cached").cast("int").alias("cached"))
