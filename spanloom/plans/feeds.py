"""Settlement, feeds, raw references and bookkeeping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import time as T
from spanloom.operators import paging, refs, settlement, versions
from spanloom.plans import projections as P
from spanloom.plans.lists import us
from spanloom.plans.projections import with_sql

QUERIES: dict = {}
ORACLE: dict = {}

NOW = datetime(2024, 1, 20, 12)
SETTLED = T.settled_before(NOW)
SETTLED_SQL = "TIMESTAMP '2024-01-20 11:55:00'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


CLOCK = """, clock AS (SELECT project_id, trace_id, max(event_ts) AS version FROM (SELECT project_id, id AS trace_id, event_ts FROM evt_traces UNION ALL SELECT project_id, trace_id, event_ts FROM evt_observations) GROUP BY ALL)"""
EVT = with_sql("evt_observations", "evt_traces") + CLOCK


def _evt(spark, sf) -> tuple[DataFrame, DataFrame]:
    return P.evt_traces(spark, sf), P.evt_observations(spark, sf)


@query("trace_activity", f"{EVT} SELECT project_id, trace_id, epoch_us(version) AS version FROM clock")
def trace_activity(spark, sf):
    return settlement.activity(*_evt(spark, sf)).select("project_id", "trace_id", us("version"))


@query("trace_activity_versions", with_sql("live_traces", "live_obs") + " SELECT project_id, trace_id, epoch_us(max(event_ts)) AS version FROM (SELECT project_id, id AS trace_id, event_ts FROM live_traces UNION ALL SELECT project_id, trace_id, event_ts FROM live_obs) GROUP BY ALL")
def trace_activity_versions(spark, sf):
    return settlement.activity(P.ord_traces(spark, sf), P.ord_observations(spark, sf)).select("project_id", "trace_id", us("version"))


JOINED = f"{EVT} SELECT t.project_id, t.id, epoch_us(timestamp) AS timestamp, epoch_us(version) AS version FROM evt_traces t JOIN clock c ON c.project_id = t.project_id AND c.trace_id = t.id"


def _versioned(df: DataFrame) -> DataFrame:
    return df.select("project_id", "id", us("timestamp"), us("trace_version", "version"))


@query("settled_trace_versions", f"{JOINED} WHERE version <= {SETTLED_SQL}")
def settled_trace_versions(spark, sf):
    return _versioned(settlement.versioned(*_evt(spark, sf), SETTLED))


@query("activity_join_single", f"{JOINED} WHERE t.id = 'u7-20240103'")
def activity_join_single(spark, sf):
    ids = spark.createDataFrame([("p1", "u7-20240103")], "project_id string, trace_id string")
    return _versioned(settlement.versioned(*_evt(spark, sf), ids=ids))


@query("activity_join_batch", f"{JOINED} WHERE t.user_id IN ('3', '33', '93')")
def activity_join_batch(spark, sf):
    traces, observations = _evt(spark, sf)
    ids = traces.where(F.col("user_id").isin("3", "33", "93")).select("project_id", F.col("id").alias("trace_id"))
    return _versioned(settlement.versioned(traces, observations, ids=ids))


@query("settled_keyset_page", f"{JOINED} WHERE version <= {SETTLED_SQL} AND (version, t.id) > (TIMESTAMP '2024-01-05', 'u1') ORDER BY version, t.id LIMIT 101")
def settled_keyset_page(spark, sf):
    return _versioned(paging.keyset_page(settlement.versioned(*_evt(spark, sf), SETTLED), ["trace_version", "id"], 100, (datetime(2024, 1, 5), "u1")))


@query("late_reopens", f"{EVT} SELECT project_id, trace_id, epoch_us(version) AS version, version <= {SETTLED_SQL} AS was_settled, version + INTERVAL 1 MINUTE <= {SETTLED_SQL} AND trace_id NOT LIKE '%20240103' AS still_settled FROM clock")
def late_reopens(spark, sf):
    """Observations that come now for one day's traces reopen exactly those."""
    traces, observations = _evt(spark, sf)
    before = settlement.activity(traces, observations)
    now = F.lit(NOW).cast("timestamp")
    late = observations.where(F.col("trace_id").endswith("20240103")).withColumns({"id": F.concat(F.lit("late-"), "id"), "event_ts": now})
    after = settlement.activity(traces, observations.unionByName(late)).withColumnRenamed("version", "later")
    settled = F.lit(SETTLED).cast("timestamp")
    still = F.timestamp_micros(F.unix_micros("later") + F.when(F.col("later") == now, 0).otherwise(60_000_000)) <= settled
    return before.join(after, ["project_id", "trace_id"]).select("project_id", "trace_id", us("version"), (F.col("version") <= settled).alias("was_settled"), still.alias("still_settled"))


# A feed of the traces' activities: an activity is an hour of a trace, published as its last event comes.
ACTS = """, acts AS (SELECT project_id, trace_id, strftime(date_trunc('hour', event_ts), '%Y%m%d%H') AS activity_id, max(event_ts) AS version, max(event_ts) AS published_at FROM evt_observations GROUP BY ALL),
feed AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY published_at DESC, activity_id DESC) AS rn FROM acts) WHERE rn = 1)"""
FEED_ROW = "project_id, trace_id, epoch_us(version) AS version, epoch_us(published_at) AS published_at"


def activities(spark, sf) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "event_ts"), "yyyyMMddHH")
    return P.evt_observations(spark, sf).groupBy("project_id", "trace_id", hour.alias("activity_id")).agg(F.max("event_ts").alias("version"), F.max("event_ts").alias("published_at"))


def _feed_rows(df: DataFrame, *more) -> DataFrame:
    return df.select("project_id", "trace_id", us("version"), us("published_at"), *more)


@query("publish_latest_activity", f"{EVT}{ACTS} SELECT {FEED_ROW}, activity_id FROM feed")
def publish_latest_activity(spark, sf):
    acts = activities(spark, sf)
    replayed = acts.unionByName(acts.withColumn("published_at", F.lit(NOW).cast("timestamp") + F.expr("INTERVAL 400 DAY")))
    return _feed_rows(settlement.publish(replayed), "activity_id")


# The stored state has moved on for some traces, is behind for others, and some have work pending.
STATUS = f"""{EVT}{ACTS}, now AS (SELECT project_id, trace_id, CASE WHEN hash_no % 10 = 1 THEN version + INTERVAL 1 SECOND WHEN hash_no % 10 = 2 THEN version - INTERVAL 1 SECOND ELSE version END AS current_version
  FROM (SELECT *, CAST(regexp_extract(trace_id, 'u([0-9]+)', 1) AS BIGINT) AS hash_no FROM clock) WHERE hash_no % 10 <> 3),
statuses AS (SELECT f.*, CASE WHEN trace_id LIKE 'u4-%' THEN 'blocked' WHEN current_version IS NULL OR version < current_version THEN 'step_over' WHEN version > current_version THEN 'blocked' WHEN version > {SETTLED_SQL} THEN 'blocked' ELSE 'emit' END AS status
  FROM feed f LEFT JOIN now n USING (project_id, trace_id))"""


def _statuses(spark, sf) -> DataFrame:
    feed = settlement.publish(activities(spark, sf))
    no = F.regexp_extract("trace_id", "u([0-9]+)", 1).cast("long") % 10
    shift = F.when(no == 1, 1_000_000).when(no == 2, -1_000_000).otherwise(0)
    current = settlement.activity(*_evt(spark, sf)).where(no != 3).withColumn("version", F.timestamp_micros(F.unix_micros("version") + shift))
    pending = feed.where(F.col("trace_id").startswith("u4-")).select("project_id", "trace_id")
    return settlement.feed_status(feed, current, pending, SETTLED)


@query("settled_feed_status", f"{STATUS} SELECT {FEED_ROW}, status FROM statuses")
def settled_feed_status(spark, sf):
    return _feed_rows(_statuses(spark, sf), "status")


PREFIX = f"{STATUS} SELECT {FEED_ROW} FROM statuses s WHERE status = 'emit' AND NOT EXISTS (FROM statuses b WHERE b.project_id = s.project_id AND b.status = 'blocked' AND (b.published_at, b.trace_id) <= (s.published_at, s.trace_id))"


@query("settled_prefix_until_blocked", PREFIX)
def settled_prefix_until_blocked(spark, sf):
    return _feed_rows(settlement.prefix(_statuses(spark, sf)))


@query("evaluator_prefix", f"{PREFIX.replace('SELECT ' + FEED_ROW, 'SELECT ' + FEED_ROW, 1)} AND (published_at, trace_id) > (TIMESTAMP '2024-01-01 06:00:00', '') ORDER BY published_at, trace_id LIMIT 26")
def evaluator_prefix(spark, sf):
    return _feed_rows(paging.keyset_page(settlement.prefix(_statuses(spark, sf)), ["published_at", "trace_id"], 25, (datetime(2024, 1, 1, 6), "")))


@query("feed_page", f"{EVT}{ACTS} SELECT {FEED_ROW} FROM feed WHERE (published_at, trace_id) > (TIMESTAMP '2024-01-10', '') ORDER BY published_at, trace_id LIMIT 51")
def feed_page(spark, sf):
    return _feed_rows(paging.keyset_page(settlement.publish(activities(spark, sf)), ["published_at", "trace_id"], 50, (datetime(2024, 1, 10), "")))


@query("feed_keys_page", f"{EVT}{ACTS} SELECT project_id, trace_id FROM feed WHERE (project_id, trace_id) > ('p1', 'u5') ORDER BY project_id, trace_id LIMIT 51")
def feed_keys_page(spark, sf):
    return paging.keyset_page(settlement.publish(activities(spark, sf)).select("project_id", "trace_id"), ["project_id", "trace_id"], 50, ("p1", "u5"))


@query("publication_lookup", f"{EVT}{ACTS} SELECT {FEED_ROW} FROM feed WHERE activity_id LIKE '%12'")
def publication_lookup(spark, sf):
    asked = activities(spark, sf).where(F.col("activity_id").endswith("12")).select("project_id", "trace_id", "activity_id").distinct()
    return _feed_rows(settlement.publish(activities(spark, sf)).join(asked, ["project_id", "trace_id", "activity_id"], "left_semi"))


@query("published_feed_dropped", f"{EVT}{ACTS} SELECT {FEED_ROW} FROM feed f WHERE NOT EXISTS (FROM clock c WHERE c.project_id = f.project_id AND c.trace_id = f.trace_id AND c.version = f.version AND f.trace_id LIKE '%01')")
def published_feed_dropped(spark, sf):
    handled = settlement.activity(*_evt(spark, sf)).where(F.col("trace_id").endswith("01"))
    return _feed_rows(settlement.drop_published(settlement.publish(activities(spark, sf)), handled))


SCORES = f"{with_sql('evt_observations', 'evt_traces', 'evt_scores')}{CLOCK}{ACTS}, changed AS (SELECT project_id, trace_id, max(event_ts) AS published_at FROM evt_scores GROUP BY ALL)"
SCORE_FEED = f"{SCORES}, sfeed AS (SELECT * FROM changed c WHERE NOT EXISTS (FROM feed f WHERE f.project_id = c.project_id AND f.trace_id = c.trace_id AND f.published_at = c.published_at))"


def _score_feed(spark, sf) -> DataFrame:
    return settlement.score_feed(P.evt_scores(spark, sf), settlement.publish(activities(spark, sf)))


@query("score_feed", f"{SCORE_FEED} SELECT project_id, trace_id, epoch_us(published_at) AS published_at FROM sfeed")
def score_feed(spark, sf):
    return _score_feed(spark, sf).select("project_id", "trace_id", us("published_at"))


@query("score_feed_page", f"{SCORE_FEED} SELECT project_id, trace_id, epoch_us(published_at) AS published_at FROM sfeed ORDER BY published_at, trace_id LIMIT 31")
def score_feed_page(spark, sf):
    return paging.keyset_page(_score_feed(spark, sf), ["published_at", "trace_id"], 30).select("project_id", "trace_id", us("published_at"))


@query("score_only_traces", f"{with_sql('docs', 'doc_scores')} SELECT DISTINCT trace_id FROM doc_scores WHERE CAST(trace_id AS BIGINT) % 2 = 1")
def score_only_traces(spark, sf):
    """Traces that scores name but the trace table (here: every other document) doesn't hold."""
    held = P.doc_traces(spark, sf).where(F.col("id").cast("long") % 2 == 0).select("project_id", F.col("id").alias("trace_id"))
    return P.doc_scores(spark, sf).select("project_id", "trace_id").distinct().join(held, ["project_id", "trace_id"], "left_anti").select("trace_id")


@query("stale_score_feed", f"{SCORE_FEED} SELECT project_id, trace_id, epoch_us(published_at) AS published_at FROM sfeed s WHERE published_at < CASE project_id WHEN 'p0' THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-15' END AND NOT EXISTS (FROM feed f WHERE f.project_id = s.project_id AND f.trace_id = s.trace_id AND f.activity_id > '2024010912')")
def stale_score_feed(spark, sf):
    cut = spark.createDataFrame([("p0", datetime(2024, 1, 10)), ("p1", datetime(2024, 1, 15)), ("p2", datetime(2024, 1, 15))], "project_id string, cutoff timestamp")
    feed = settlement.publish(activities(spark, sf)).where("activity_id > '2024010912'")
    return settlement.stale_scores(_score_feed(spark, sf), cut, feed).select("project_id", "trace_id", us("published_at"))


@query("pending_union", f"{EVT}{ACTS} SELECT DISTINCT project_id, trace_id FROM evt_observations WHERE name = 'signup' OR (name = 'click' AND CAST(id AS BIGINT) % 2 = 0)")
def pending_union(spark, sf):
    o = P.evt_observations(spark, sf)
    raw = o.where("name = 'signup'").select("project_id", "trace_id")
    imports = o.where("name = 'click'").select("project_id", "trace_id", F.lit("pending").alias("status"), (F.col("id").cast("long") % 2 == 0).alias("publish_required"))
    return settlement.pending_union(raw, imports)


CUTS = "(VALUES ('p0', TIMESTAMP '2024-01-05'), ('p1', TIMESTAMP '2024-01-09')) r(project_id, cutoff)"
WANT = "(SELECT project_id, max(event_ts) - INTERVAL 20 DAY AS cutoff FROM evt_observations GROUP BY ALL)"


def _cuts(spark, sf) -> tuple[DataFrame, DataFrame]:
    recorded = spark.createDataFrame([("p0", datetime(2024, 1, 5)), ("p1", datetime(2024, 1, 9))], "project_id string, cutoff timestamp").withColumn("cutoff", F.col("cutoff"))
    proposed = P.evt_observations(spark, sf).groupBy("project_id").agg((F.max("event_ts") - F.expr("INTERVAL 20 DAY")).alias("cutoff"))
    return recorded, proposed


@query("import_cutoffs_forward_only", f"{with_sql('evt_observations')} SELECT project_id, epoch_us(max(cutoff)) AS cutoff FROM (FROM {CUTS} UNION ALL FROM {WANT}) GROUP BY ALL")
def import_cutoffs_forward_only(spark, sf):
    return settlement.forward_only_cutoffs(*_cuts(spark, sf)).select("project_id", us("cutoff"))


@query("seed_cutoffs", f"{with_sql('evt_observations')} SELECT project_id, epoch_us(cutoff) AS cutoff FROM (FROM {CUTS} UNION ALL (FROM {WANT} w WHERE NOT EXISTS (FROM {CUTS} WHERE r.project_id = w.project_id)))")
def seed_cutoffs(spark, sf):
    return settlement.seed_cutoffs(*_cuts(spark, sf)).select("project_id", us("cutoff"))


# Raw references: a lineitem is a reference of its order's trace to the object of a part; its state comes from
# line status and return flag.
REFS = """WITH refs AS (SELECT 'p' || (l_orderkey % 4) AS project_id, CAST(l_orderkey AS VARCHAR) AS trace_id, 'raw/' || (l_partkey % 5) AS object_key, l_shipdate::TIMESTAMP AS received_at,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 2 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS applied FROM lineitem),
states AS (SELECT project_id, trace_id, object_key, max(applied) AS applied, min(received_at) AS received_at FROM refs GROUP BY ALL)"""


def raw_refs(spark, sf) -> DataFrame:
    li = P._read(spark, sf, "lineitem")
    state = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), 2).when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return li.select(
        F.concat(F.lit("p"), F.col("l_orderkey") % 4).alias("project_id"), F.col("l_orderkey").cast("string").alias("trace_id"), F.concat(F.lit("raw/"), F.col("l_partkey") % 5).alias("object_key"),
        F.col("l_shipdate").cast("timestamp").alias("received_at"), F.col("l_shipdate").cast("timestamp").alias("event_ts"), state.cast("tinyint").alias("applied"), F.col("l_quantity").cast("long").alias("size"),
    )


for _name, _state, _f in (("raw_index_applied", 1, refs.applied), ("raw_pending", 0, refs.pending), ("raw_expired", 2, refs.expired)):
    query(_name, f"{REFS} SELECT project_id, trace_id, object_key, epoch_us(received_at) AS received_at FROM states WHERE applied = {_state}")(
        lambda spark, sf, f=_f: f(raw_refs(spark, sf)).select("project_id", "trace_id", "object_key", us("received_at"))
    )


@query("raw_pending_counts", f"{REFS} SELECT project_id, trace_id, count(*) AS pending FROM states WHERE applied = 0 GROUP BY ALL")
def raw_pending_counts(spark, sf):
    return refs.pending_traces(raw_refs(spark, sf))


@query("raw_trace_index", f"{REFS} SELECT project_id, trace_id, object_key, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY received_at, object_key) AS n FROM states WHERE applied = 1) WHERE n <= 3")
def raw_trace_index(spark, sf):
    return refs.trace_index(raw_refs(spark, sf), 2).select("project_id", "trace_id", "object_key", F.col("n").cast("long").alias("n"))


@query("raw_capped", """WITH o AS (SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS object_key, min(l_shipdate) AS received_at, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL)
SELECT trace_id, object_key, CASE WHEN n > 4 THEN 'object_limit' WHEN b > 120 THEN 'byte_limit' END AS truncated FROM (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS b FROM o WINDOW w AS (PARTITION BY trace_id ORDER BY received_at, object_key))""")
def raw_capped(spark, sf):
    li = P._read(spark, sf, "lineitem")
    objects = li.groupBy(F.lit("p").alias("project_id"), F.col("l_orderkey").cast("string").alias("trace_id"), F.col("l_linenumber").cast("string").alias("object_key")).agg(F.min("l_shipdate").alias("received_at"), F.sum("l_quantity").cast("long").alias("size"))
    return refs.within_caps(objects, 4, 120).select("trace_id", "object_key", "truncated")


@query("raw_visible_union", with_sql("live_traces", "live_obs", "doc_scores") + " SELECT project_id, id AS trace_id FROM live_traces UNION SELECT project_id, trace_id FROM live_obs UNION SELECT 'p0', trace_id FROM doc_scores")
def raw_visible_union(spark, sf):
    return refs.visible(versions.latest(P.ord_traces(spark, sf), "traces"), versions.latest(P.ord_observations(spark, sf), "observations"), P.doc_scores(spark, sf))


@query("raw_anchor", f"{with_sql('live_traces')} SELECT id, array_to_string(tags, ',') AS tags, epoch_us(event_ts) AS event_ts FROM live_traces WHERE project_id = 'p1' AND id = '1001'")
def raw_anchor(spark, sf):
    live = versions.latest(P.ord_traces(spark, sf).where("project_id = 'p1' and id = '1001'"), "traces")
    return live.select("id", F.array_join("tags", ",").alias("tags"), us("event_ts"))


@query("rate_limit_windows", """SELECT 'p' || (user_id % 3) AS project_id, epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS window_start, count(*) AS requests, count(*) > 1 AS limited FROM events GROUP BY ALL""")
def rate_limit_windows(spark, sf):
    e = P.evt_observations(spark, sf)
    counted = e.groupBy("project_id", F.window("start_time", "60 seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select("project_id", us("w.start", "window_start"), "requests", (F.col("requests") > 1).alias("limited"))


BUCKETS = (5, 10, 25, 50, 100, 250, 500)


@query("request_duration_histogram", "SELECT event_type AS route, b AS le, count(*) FILTER (value <= b) AS n FROM events, (VALUES (5), (10), (25), (50), (100), (250), (500)) t(b) GROUP BY ALL")
def request_duration_histogram(spark, sf):
    e = P.evt_observations(spark, sf)
    one = e.groupBy(F.col("name").alias("route")).agg(*[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in BUCKETS])
    return one.select("route", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in BUCKETS])).alias("x")).select("route", "x.le", "x.n")
