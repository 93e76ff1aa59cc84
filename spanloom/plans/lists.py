"""Lists, filters, figures and pages over traces."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import figures, filters, paging, versions
from spanloom.operators.filters import TraceFilter
from spanloom.plans import projections as P
from spanloom.plans.projections import with_sql

QUERIES: dict = {}
ORACLE: dict = {}

SINCE, UNTIL = datetime(1996, 3, 1), datetime(1997, 9, 30)
RANGE_SQL = "timestamp >= TIMESTAMP '1996-03-01' AND timestamp <= TIMESTAMP '1997-09-30'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def us(column: str, name: str | None = None):
    return F.unix_micros(column).alias(name or column)


def _ord(spark, sf) -> tuple[DataFrame, DataFrame]:
    return P.ord_traces(spark, sf), P.ord_observations(spark, sf)


TRACE_COLUMNS = "project_id, id, epoch_us(timestamp) AS timestamp, name, epoch_us(event_ts) AS event_ts"


def _trace_rows(df: DataFrame) -> DataFrame:
    return df.select("project_id", "id", us("timestamp"), "name", us("event_ts"))


@query("latest_traces", f"{with_sql('ord_traces')} SELECT {TRACE_COLUMNS}, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY project_id, CAST(timestamp AS DATE), id ORDER BY event_ts DESC, seq DESC) AS rn FROM ord_traces) WHERE rn = 1")
def latest_traces(spark, sf):
    df = versions.latest(P.ord_traces(spark, sf), "traces", deleted=True)
    return df.select("project_id", "id", us("timestamp"), "name", us("event_ts"), "is_deleted")


@query("live_after_tombstones", f"{with_sql('live_traces')} SELECT {TRACE_COLUMNS} FROM live_traces")
def live_after_tombstones(spark, sf):
    return _trace_rows(versions.latest(P.ord_traces(spark, sf), "traces"))


@query("latest_observations", f"{with_sql('live_obs')} SELECT project_id, trace_id, id, epoch_us(event_ts) AS event_ts, level, model, round(CAST(cost AS DOUBLE), 4) AS cost, CAST(tokens AS BIGINT) AS tokens FROM live_obs")
def latest_observations(spark, sf):
    df = versions.latest(P.ord_observations(spark, sf), "observations")
    cost = F.when(figures.reported(F.col("cost_details")), figures.observation_cost(F.col("cost_details")))
    tokens = F.when(figures.reported(F.col("usage_details")), figures.observation_tokens(F.col("usage_details")))
    return df.select("project_id", "trace_id", "id", us("event_ts"), "level", "model", F.round(cost.cast("double"), 4).alias("cost"), tokens.cast("long").alias("tokens"))


@query("latest_by_id_across_days", f"{with_sql('live_traces')} SELECT {TRACE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY event_ts DESC, seq DESC) AS rn FROM live_traces) WHERE rn = 1")
def latest_by_id_across_days(spark, sf):
    return _trace_rows(versions.latest_by_id(P.ord_traces(spark, sf), "traces"))


def _asked(spark, sf, every: int) -> DataFrame:
    """Every so many orders' ids, and as many that don't exist."""
    o = P.ord_traces(spark, sf).where(F.col("id").cast("long") % every == 0).select("project_id", "id").distinct()
    return o.unionByName(o.select("project_id", F.concat(F.lit("none-"), "id").alias("id")))


@query("existing_ids", f"{with_sql('live_traces')} SELECT DISTINCT project_id, id FROM live_traces WHERE CAST(id AS BIGINT) % 13 = 0")
def existing_ids(spark, sf):
    return versions.existing_ids(P.ord_traces(spark, sf), _asked(spark, sf, 13))


@query(
    "stored_row_keys",
    with_sql("live_traces", "live_obs")
    + """ SELECT 'trace' AS kind, project_id, '' AS trace_id, id, epoch_us(timestamp) AS sort_time, epoch_us(event_ts) AS event_ts FROM live_traces WHERE CAST(id AS BIGINT) % 13 = 0
    UNION ALL SELECT 'observation', project_id, trace_id, id, epoch_us(start_time), epoch_us(event_ts) FROM live_obs WHERE CAST(trace_id AS BIGINT) % 13 = 0 AND id = '1'""",
)
def stored_row_keys(spark, sf):
    traces, observations = _ord(spark, sf)
    ids = _asked(spark, sf, 13)
    records = ids.select(F.lit("trace").alias("kind"), "project_id", F.lit("").alias("trace_id"), "id").unionByName(ids.select(F.lit("observation").alias("kind"), "project_id", F.col("id").alias("trace_id"), F.lit("1").alias("id")))
    scores = P.evt_scores(spark, sf)
    return versions.stored_row_keys(traces, observations, scores, records).select("kind", "project_id", "trace_id", "id", us("sort_time"), us("event_ts"))


@query("month_inventory", f"{with_sql('ord_traces')} SELECT strftime(timestamp, '%Y-%m') AS month, epoch_us(min(timestamp)) AS first, epoch_us(max(timestamp)) AS last FROM ord_traces GROUP BY ALL")
def month_inventory(spark, sf):
    return versions.months(P.ord_traces(spark, sf), "traces").select("month", us("first"), us("last"))


@query("observations_by_ids", f"{with_sql('live_obs')} SELECT project_id, trace_id, id, epoch_us(event_ts) AS event_ts FROM live_obs WHERE CAST(trace_id AS BIGINT) % 17 = 0 AND id IN ('1', '3')")
def observations_by_ids(spark, sf):
    o = P.ord_observations(spark, sf)
    ids = o.where((F.col("trace_id").cast("long") % 17 == 0) & F.col("id").isin("1", "3")).select("project_id", "trace_id", "id").distinct()
    return versions.of_ids(o, ids, "observations").select("project_id", "trace_id", "id", us("event_ts"))


# Filters. Every one is checked as a list and as a count of the same matched set.
LEVEL = "EXISTS (FROM live_obs o WHERE o.project_id = t.project_id AND o.trace_id = t.id AND o.level = 'error')"
MODEL = "EXISTS (FROM live_obs o WHERE o.project_id = t.project_id AND o.trace_id = t.id AND o.model = 'model-7')"
DURATION = "EXISTS (FROM metrics m WHERE m.project_id = t.project_id AND m.id = t.id AND m.duration_ms >= 240000)"
COST = "EXISTS (FROM metrics m WHERE m.project_id = t.project_id AND m.id = t.id AND m.total_cost >= 150000.7)"
SETTLED_BY = """greatest((SELECT max(x.event_ts) FROM live_traces x WHERE x.project_id = t.project_id AND x.id = t.id),
  (SELECT max(o.event_ts) FROM live_obs o WHERE o.project_id = t.project_id AND o.trace_id = t.id)) <= TIMESTAMP '1997-06-01'"""
FILTERS = {
    "filter_project": (TraceFilter(project_id="p2"), "project_id = 'p2'"),
    "filter_time_range": (TraceFilter(since=SINCE, until=UNTIL), RANGE_SQL),
    "filter_user": (TraceFilter(user_id="77"), "user_id = '77'"),
    "filter_session": (TraceFilter(session_id="s7"), "session_id = 's7'"),
    "filter_environment": (TraceFilter(environment="1-URGENT"), "environment = '1-URGENT'"),
    "filter_tags_all": (TraceFilter(tags=("O", "2-HIGH")), "list_has_all(tags, ['O', '2-HIGH'])"),
    "filter_metadata": (TraceFilter(metadata=("third", "2")), "third = '2'"),
    "filter_level": (TraceFilter(level="error"), LEVEL),
    "filter_model": (TraceFilter(model="model-7"), MODEL),
    "filter_min_duration": (TraceFilter(min_duration_ms=240_000), DURATION),
    "filter_min_cost": (TraceFilter(min_cost=Decimal("150000.7")), COST),
    "filter_settled": (TraceFilter(settled_before=datetime(1997, 6, 1)), SETTLED_BY),
    "filter_all_combined": (TraceFilter(since=SINCE, until=UNTIL, tags=("O",), level="error", min_duration_ms=240_000, min_cost=Decimal("150000.7")), f"{RANGE_SQL} AND list_contains(tags, 'O') AND {LEVEL} AND {DURATION} AND {COST}"),
}


def _filter(f: TraceFilter):
    def run(spark, sf):
        live, _ = filters.matched(*_ord(spark, sf), f)
        return _trace_rows(live)

    return run


for _name, (_f, _sql) in FILTERS.items():
    query(_name, f"{with_sql('live_traces', 'metrics')} SELECT {TRACE_COLUMNS} FROM live_traces t WHERE {_sql}")(_filter(_f))


@query("filter_counts", with_sql("live_traces", "metrics") + " " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS traces FROM live_traces t WHERE {s}" for n, (_, s) in FILTERS.items()))
def filter_counts(spark, sf):
    """The aggregates' count for each filter; equals the length of the list."""
    return filters.counted(*_ord(spark, sf), {n: f for n, (f, _) in FILTERS.items()})


@query("filter_search", f"""{with_sql('docs', 'conv')} SELECT id, name FROM docs WHERE contains(lower(input), lower('ÉTION')) OR contains(lower(name), lower('ÉTION')) OR id = 'ÉTION'
OR EXISTS (FROM conv c WHERE c.trace_id = docs.id AND (contains(lower(c.input), lower('ÉTION')) OR contains(lower(c.output), lower('ÉTION')) OR contains(lower(c.name), lower('ÉTION'))))""")
def filter_search(spark, sf):
    """Documents as traces; the turns of the conversation of the same number are searched with them."""
    return filters.matched(P.doc_traces(spark, sf), P.conv_observations(spark, sf), TraceFilter(search="ÉTION"))[0].select("id", "name")


@query("filter_search_or_id", f"{with_sql('conv')} SELECT DISTINCT trace_id AS id FROM conv WHERE trace_id = '12' OR contains(lower(input), '12') OR contains(lower(output), '12') OR contains(lower(name), '12') OR contains('conversation ' || trace_id, '12')")
def filter_search_or_id(spark, sf):
    return filters.matched(P.conv_traces(spark, sf), P.conv_observations(spark, sf), TraceFilter(search="12"))[0].select("id")


@query("scoped_equals_unscoped", f"""{with_sql('live_traces', 'metrics')} SELECT scope, {TRACE_COLUMNS} FROM live_traces t, (VALUES ('scoped'), ('unscoped')) v(scope)
WHERE {RANGE_SQL} AND {LEVEL} AND EXISTS (FROM metrics m WHERE m.project_id = t.project_id AND m.id = t.id AND m.total_cost >= 100000)""")
def scoped_equals_unscoped(spark, sf):
    """The same list twice: observations limited to the traces that the range leaves, and all of them."""
    f = TraceFilter(since=SINCE, until=UNTIL, level="error", min_cost=Decimal("100000"))
    one, two = (_trace_rows(filters.matched(*_ord(spark, sf), f, scope=s)[0]).withColumn("scope", F.lit("scoped" if s else "unscoped")) for s in (True, False))
    return one.unionByName(two)


@query("destination_filter", f"{with_sql('live_traces')} SELECT project_id, id FROM live_traces WHERE {RANGE_SQL} AND list_contains(tags, 'F') AND third = '1'")
def destination_filter(spark, sf):
    f = TraceFilter(since=SINCE, until=UNTIL, environment="ignored", tags=("F",), metadata=("third", "1"))
    return versions.latest(P.ord_traces(spark, sf), "traces").where(filters.matches_destination(f)).select("project_id", "id")


@query("imported_tag_traces", f"{with_sql('docs')} SELECT id FROM docs WHERE list_contains(tags, 'imported:langsmith')")
def imported_tag_traces(spark, sf):
    return P.doc_traces(spark, sf).where(filters.imported(F.col("tags"))).select("id")


# Figures
METRICS_SQL = "duration_ms, round(CAST(total_cost AS DOUBLE), 4) AS total_cost, CAST(total_tokens AS BIGINT) AS total_tokens"


def _figures(df: DataFrame) -> list:
    return [F.col("duration_ms"), F.round(F.col("total_cost").cast("double"), 4).alias("total_cost"), F.col("total_tokens").cast("long").alias("total_tokens"), F.col("error_count"), F.array_join("models", ",").alias("models")]


@query("trace_metrics", f"{with_sql('metrics')} SELECT project_id, id, {METRICS_SQL}, error_count, array_to_string(models, ',') AS models FROM metrics")
def trace_metrics(spark, sf):
    m = figures.trace_metrics(versions.latest(figures.figured(P.ord_observations(spark, sf)), "observations"))
    return m.select("project_id", "id", *_figures(m))


@query("trace_metrics_events", f"{with_sql('evt_observations')} SELECT project_id, trace_id AS id, epoch_us(max(end_time)) // 1000 - epoch_us(min(start_time)) // 1000 AS duration_ms, count(*) FILTER (level = 'error') AS error_count FROM evt_observations GROUP BY ALL")
def trace_metrics_events(spark, sf):
    return figures.trace_metrics(versions.latest(P.evt_observations(spark, sf), "observations")).select("project_id", "id", "duration_ms", "error_count")


PAGE = TraceFilter(since=SINCE, until=UNTIL, model="model-7")
PAGE_SQL = f"""{with_sql('live_traces', 'metrics')}, matched AS (SELECT * FROM live_traces t WHERE {RANGE_SQL} AND {MODEL})"""
PAGE_ROW = f"project_id, id, epoch_us(timestamp) AS timestamp, name, user_id, environment, {METRICS_SQL}, coalesce(error_count, 0) AS error_count, coalesce(array_to_string(models, ','), '') AS models"


def _page(spark, sf, after=None):
    traces, observations = _ord(spark, sf)
    live, _ = filters.matched(traces, observations, PAGE)
    live = live.select("project_id", "id", "timestamp", "name", "user_id", "environment")
    page, found = paging.held(paging.keyset_page(live, ["timestamp", "id"], filters.DEFAULT_LIMIT, after, descending=True))
    children = versions.latest(paging.of_page(observations, found), "observations")
    rows = figures.with_metrics(page, figures.trace_metrics(children))
    return rows.select("project_id", "id", us("timestamp"), "name", "user_id", "environment", *_figures(rows))


@query("trace_list_page", f"{PAGE_SQL} SELECT {PAGE_ROW} FROM (SELECT * FROM matched ORDER BY timestamp DESC, id DESC LIMIT 21) LEFT JOIN metrics USING (project_id, id)")
def trace_list_page(spark, sf):
    """The flagship: one page of filtered traces, newest first, with their exact figures."""
    return _page(spark, sf)


@query("trace_list_next_page", f"{PAGE_SQL} SELECT {PAGE_ROW} FROM (SELECT * FROM matched WHERE (timestamp, id) < (TIMESTAMP '1997-03-01', '5') ORDER BY timestamp DESC, id DESC LIMIT 21) LEFT JOIN metrics USING (project_id, id)")
def trace_list_next_page(spark, sf):
    return _page(spark, sf, (datetime(1997, 3, 1), "5"))


@query("trace_offset_page", f"{with_sql('live_traces')} SELECT project_id, id, epoch_us(timestamp) AS timestamp FROM live_traces ORDER BY timestamp, id, project_id LIMIT 50 OFFSET 100")
def trace_offset_page(spark, sf):
    live = versions.latest(P.ord_traces(spark, sf), "traces")
    return paging.offset_page(live, [F.asc("timestamp"), F.asc("id"), F.asc("project_id")], 3, 50).select("project_id", "id", us("timestamp"))


@query("trace_page_total", f"{with_sql('live_traces')} SELECT count(*) AS total_items, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM live_traces")
def trace_page_total(spark, sf):
    return paging.page_total(versions.latest(P.ord_traces(spark, sf), "traces"), 50)


# Aggregates
AGG = TraceFilter(project_id="p1", since=SINCE, until=UNTIL)
AGG_SQL = f"""{with_sql('live_traces', 'live_obs')}, matched AS (SELECT * FROM live_traces WHERE project_id = 'p1' AND {RANGE_SQL}),
seen AS (SELECT * FROM live_obs o WHERE EXISTS (FROM matched m WHERE m.project_id = o.project_id AND m.id = o.trace_id))"""


def _matched(spark, sf):
    live, seen = filters.matched(*_ord(spark, sf), AGG)
    return live, filters.scoped(seen, live)


@query("agg_trace_count", f"{AGG_SQL} SELECT count(*) AS trace_count FROM matched")
def agg_trace_count(spark, sf):
    return _matched(spark, sf)[0].agg(F.count("*").alias("trace_count"))


@query("agg_token_totals", f"{AGG_SQL} SELECT key, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'input_tokens' AS key, tok_in AS v FROM seen UNION ALL SELECT 'output_tokens', tok_out FROM seen UNION ALL SELECT 'total_tokens', tok_total FROM seen) WHERE v IS NOT NULL GROUP BY key")
def agg_token_totals(spark, sf):
    return figures.map_totals(_matched(spark, sf)[1], "usage_details").select("key", F.col("total").cast("long").alias("total"))


@query("agg_cost_totals", f"{AGG_SQL} SELECT key, round(CAST(sum(v) AS DOUBLE), 4) AS total FROM (SELECT 'input' AS key, cost_in AS v FROM seen UNION ALL SELECT 'output', cost_out FROM seen UNION ALL SELECT 'total', cost_total FROM seen) WHERE v IS NOT NULL GROUP BY key")
def agg_cost_totals(spark, sf):
    return figures.map_totals(_matched(spark, sf)[1], "cost_details").select("key", F.round(F.col("total").cast("double"), 4).alias("total"))


@query(
    "agg_latency_percentiles",
    f"""{AGG_SQL} SELECT round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99
    FROM (SELECT epoch_ms(max(end_time)) - epoch_ms(min(start_time)) AS ms FROM seen GROUP BY project_id, trace_id HAVING max(end_time) IS NOT NULL)""",
)
def agg_latency_percentiles(spark, sf):
    p = figures.latency_percentiles(_matched(spark, sf)[1])
    return p.select(*[F.round(c, 3).alias(c) for c in p.columns])


@query(
    "agg_kpi_tiles",
    f"""{AGG_SQL}, t AS (SELECT sum(tok_total) AS tt, sum(cost_total) AS ct FROM seen)
    SELECT 'traces' AS tile, CAST((SELECT count(*) FROM matched) AS DOUBLE) AS value UNION ALL SELECT 'tokens', CAST(tt AS DOUBLE) FROM t UNION ALL SELECT 'cost', round(CAST(ct AS DOUBLE), 4) FROM t
    UNION ALL SELECT 'latency', round(quantile_cont(ms, 0.95), 3) FROM (SELECT epoch_ms(max(end_time)) - epoch_ms(min(start_time)) AS ms FROM seen GROUP BY project_id, trace_id HAVING max(end_time) IS NOT NULL)""",
)
def agg_kpi_tiles(spark, sf):
    tiles = figures.kpi_tiles(figures.aggregates(*_matched(spark, sf)))
    return tiles.select("tile", F.round("value", 3).alias("value"))
