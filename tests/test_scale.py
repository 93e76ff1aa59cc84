"""What keeps queries in proportion to their input: passes over tables, shuffles, and no call per group."""

import random

from pyspark.sql import functions as F

from spanloom.functions import pricing, usage
from spanloom.operators import figures, filters, settlement, tree, versions
from spanloom.plans import exports, ingest, lists, services, upkeep
from spanloom.plans import projections as P
from spanloom.sources import otlp


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_are_built_many_at_a_time(spark):
    rnd = random.Random(5)
    rows, told = [], set()
    for t in range(3000):
        ids = [str(i) for i in range(rnd.randint(1, 9))]
        mine = [(rnd.choice(ids), rnd.choice([None, "gone", *ids]), second) for second in rnd.sample(range(50), len(ids))]
        rows += [("p" if t % 2 else None, f"t{t}", i, up, second) for i, up, second in mine]
        told |= {("p" if t % 2 else None, f"t{t}", *r) for r in tree.build(sorted(mine, key=lambda r: (r[2], r[0])))}
    observations = spark.createDataFrame(rows, "project_id string, trace_id string, id string, parent_observation_id string, at int").selectExpr("* except (at)", "timestamp_seconds(at) AS start_time")
    made = tree.observation_tree(observations)
    assert "FlatMapGroupsIn" not in planned(made)  # a call per trace
    got = [tuple(r) for r in made.select("project_id", "trace_id", "id", "parent_id", "depth", "place", "is_root", "n_children", "last").collect()]
    assert len(got) == len(told) and set(got) == told
    assert tree.observation_tree(observations.limit(0)).count() == 0


def test_a_trace_may_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chains = spark.range(90).selectExpr("'p' AS project_id", "cast(id div 30 as string) AS trace_id", "cast(id % 30 as string) AS id", "cast(nullif(id % 30, 0) - 1 as string) AS parent_observation_id", "timestamp_seconds(id) AS start_time")
        assert {(r.trace_id, r.id, r.depth, r.place, r["last"]) for r in tree.observation_tree(chains).collect()} == {(str(t), str(i), i, i, 29) for t in range(3) for i in range(30)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_build_their_trees_once(spark, sf_dir):
    assert planned(exports.otlp_reemission_spans(spark, sf_dir)).count("MapInArrow") == 1


def test_versions_are_dealt_by_trace_before_they_are_ranked(spark, sf_dir):
    """No task sorts a split of the input, and a grouping by trace moves nothing again."""
    live = versions.latest(P.ord_observations(spark, sf_dir), "observations")
    for df in (live, live.groupBy("project_id", "trace_id").count()):
        plan = planned(df)
        assert plan.count("Exchange hashpartitioning") == 1
        assert not any(step in plan[plan.index("Exchange hashpartitioning") :] for step in ("Sort", "WindowGroupLimit"))
    scans = planned(settlement.activity(P.ord_traces(spark, sf_dir), P.ord_observations(spark, sf_dir)))
    assert "WindowGroupLimit" not in scans[scans.rindex("Exchange hashpartitioning") :]


def test_figures_come_before_versions_collapse(spark, sf_dir):
    """What is shuffled for a trace's figures are two numbers and no maps."""
    plan = planned(lists.trace_metrics(spark, sf_dir))
    moved = plan[plan.index("Exchange hashpartitioning") :].split("Project", 1)[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "_details" not in moved
    whole = P.ord_observations(spark, sf_dir)
    same = [figures.trace_metrics(versions.latest(o, "observations")) for o in (whole, figures.figured(whole))]
    assert same[0].exceptAll(same[1]).isEmpty() and same[1].exceptAll(same[0]).isEmpty()


def test_counts_of_all_filters_take_one_pass(spark, sf_dir):
    """Each filter's count is its list's length, searches and combinations too."""
    assert planned(lists.filter_counts(spark, sf_dir)).count("lineitem.parquet") == 1
    traces, observations = P.conv_traces(spark, sf_dir), P.conv_observations(spark, sf_dir)
    some = {"hit": filters.TraceFilter(search="12"), "none": filters.TraceFilter(search="12", project_id="p9"), "level": filters.TraceFilter(search="a", level="default"), "model": filters.TraceFilter(model="m"), "all": filters.TraceFilter()}
    counted = {r["filter"]: r["traces"] for r in filters.counted(traces, observations, some).collect()}
    assert counted == {n: filters.matched(traces, observations, f)[0].count() for n, f in some.items()}


def test_a_filters_conditions_on_observations_take_one_pass(spark, sf_dir):
    f = filters.TraceFilter(level="error", min_cost=lists.FILTERS["filter_min_cost"][0].min_cost, min_duration_ms=1)
    assert planned(filters.matched(*lists._ord(spark, sf_dir), f)[0]).count("lineitem.parquet") == 1


def test_usage_is_renamed_from_one_reading(spark):
    """Spark computes equal parts of a higher-order function again, so the cleaned map stands there once."""
    sent = spark.sql("SELECT map('promptTokens', 5D, 'input', 6D, 'output_tokens', 2.5D, 'completion_tokens', 9D, 'bad', -1D, 'x', 0D) AS m UNION ALL SELECT map('bad', -1D) UNION ALL SELECT null")
    out = sent.select(usage.counts(F.col("m")).alias("m"))
    assert usage.counts(F.col("m"))._jc.toString().count("transform_values") == 1
    assert [r.m and {k: int(v) for k, v in r.m.items()} for r in out.collect()] == [{"output_tokens": 3, "x": 0, "input_tokens": 5}, None, None]


def test_model_names_are_cut_once(spark):
    out = spark.sql("SELECT ' OpenAI/GPT-20240501 ' AS m").select(pricing.candidates(F.col("m")).alias("m"))
    assert len(pricing.candidates(F.col("m"))._jc.toString()) < 12_000  # the names stood in it many times over
    assert out.first().m[:5] == ["OpenAI/GPT-20240501", "openai/gpt-20240501", "gpt-20240501", "openai/gpt", "gpt"]


def test_items_are_parsed_once(spark, sf_dir):
    for query in (services.compat_observation_items, services.compat_trace_items, services.compat_score_items):
        plan = planned(query(spark, sf_dir))
        assert "get_json_object" not in plan and plan.count("from_json") == 1


def test_span_attributes_are_read_once(spark, sf_dir):
    o = otlp.observations(otlp.spans(ingest.otlp_events(spark, sf_dir)))
    assert "filter(span#" not in planned(o) and planned(o.select("usage_details", "model_parameters", "model")).count("map_from_entries(transform(") == 1


def test_merged_requests_are_one_grouping(spark, sf_dir):
    for query in (services.langfuse_map_traces, ingest.langfuse_map):
        plan = planned(query(spark, sf_dir))
        assert "Join" not in plan and plan.count("try_parse_json(body") <= 1


def test_candidates_are_made_on_all_cores(spark, sf_dir):
    """Names cost far more than the reading of a model, and a file of many models is one task's."""
    df = upkeep.model_candidates(spark, sf_dir)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
