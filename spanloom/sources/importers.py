"""Rows from what two other trace services return to a pull: lists of traces with their children, and runs
with feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text, usage
from spanloom.operators.filters import IMPORT_TAGS


def own_children(traces: DataFrame, children: DataFrame) -> DataFrame:
    """Children of the snapshot's own traces; what names another trace or project stays out."""
    return children.join(traces.select("project_id", F.col("id").alias("trace_id")).distinct(), ["project_id", "trace_id"], "left_semi")


def mixed_identity(traces: DataFrame) -> DataFrame:
    """(id): snapshots whose rows name more than one project; they must not be written."""
    return traces.groupBy("id").agg(F.count_distinct("project_id").alias("n")).where("n > 1").select("id")


def map_list_traces(pulled: DataFrame, project_id: str) -> DataFrame:
    """Traces of the list form: (id, timestamp, name, userId, sessionId, environment, release, version, tags,
    metadata, input, output as JSON text). The importer's tag is added once."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return pulled.select(
        F.lit(project_id).alias("project_id"), "id", F.to_timestamp("timestamp").alias("timestamp"), F.nullif("name", F.lit("")).alias("name"), F.nullif("userId", F.lit("")).alias("user_id"),
        F.nullif("sessionId", F.lit("")).alias("session_id"), text.environment(F.col("environment")).alias("environment"), F.nullif("release", F.lit("")).alias("release"), F.nullif("version", F.lit("")).alias("version"),
        F.array_distinct(F.concat(tags, F.array(F.lit(IMPORT_TAGS[0])))).alias("tags"), F.coalesce(text.json_map(F.col("metadata")), F.expr("cast(map() as map<string,string>)")).alias("metadata"), "input", "output",
    )


def legacy_cost(details: Column, input_cost: Column, output_cost: Column, total: Column) -> Column:
    """Cost details, or those of the older fields where they are missing."""
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), usage.cost_amount(v).alias("value")) for k, v in (("input", input_cost), ("output", output_cost), ("total", total))]), lambda e: e["value"].isNotNull())
    clean = F.map_filter(F.transform_values(details, lambda _, v: usage.cost_amount(v)), lambda _, v: v.isNotNull())
    return F.when(F.coalesce(F.size(clean) > 0, F.lit(False)), clean).when(F.size(parts) > 0, F.map_from_entries(parts))


def map_list_observations(pulled: DataFrame, project_id: str) -> DataFrame:
    """Observations of the detail form, unknown types and levels falling back to span and default."""
    linked = F.map_filter(F.create_map(F.lit("prompt_name"), "promptName", F.lit("prompt_version"), F.col("promptVersion").cast("string")), lambda _, v: v.isNotNull())
    own = F.coalesce(text.json_map(F.col("metadata")), F.expr("cast(map() as map<string,string>)"))
    return pulled.select(
        F.lit(project_id).alias("project_id"), "id", F.col("traceId").alias("trace_id"), F.nullif("parentObservationId", F.lit("")).alias("parent_observation_id"), text.one_of(F.col("type"), text.TYPES, "span").alias("type"),
        F.nullif("name", F.lit("")).alias("name"), F.to_timestamp("startTime").alias("start_time"), F.to_timestamp("endTime").alias("end_time"), text.one_of(F.col("level"), text.LEVELS, "default").alias("level"),
        F.nullif("statusMessage", F.lit("")).alias("status_message"), F.nullif("model", F.lit("")).alias("model"), "input", "output", usage.counts(F.col("usageDetails")).alias("usage_details"),
        legacy_cost(F.col("costDetails"), F.col("calculatedInputCost"), F.col("calculatedOutputCost"), F.col("calculatedTotalCost")).alias("cost_details"),
        F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(linked, k)), linked).alias("metadata"),
    )


def map_list_scores(pulled: DataFrame, project_id: str) -> DataFrame:
    """Scores with a value or text; others are dropped."""
    kind = F.lower("dataType")
    return pulled.where("(value is not null or stringValue is not null) and id is not null and traceId is not null and name is not null").select(
        F.lit(project_id).alias("project_id"), "id", F.col("traceId").alias("trace_id"), F.nullif("observationId", F.lit("")).alias("observation_id"), "name",
        F.when(kind.isin("numeric", "categorical", "boolean"), kind).otherwise(text.score_type(F.col("value"), F.col("stringValue"))).alias("data_type"),
        F.col("value").cast("double").alias("value"), F.col("stringValue").alias("string_value"), text.one_of(F.col("source"), text.SOURCES, "api").alias("source"), F.lit("langfuse").alias("import_source"),
        "comment", F.to_timestamp("timestamp").alias("timestamp"),
    )


def _run_level() -> Column:
    return F.when((F.lower("status") == "error") | (F.coalesce("error", F.lit("")) != ""), "error").otherwise("default")


def map_runs(pulled: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """(traces, observations) of a run tree: a run without a parent is a trace as well; ``llm`` runs are
    generations; costs come as decimals in text."""
    counts = F.map_filter(F.create_map(F.lit("input_tokens"), usage.token_count(F.col("prompt_tokens")), F.lit("output_tokens"), usage.token_count(F.col("completion_tokens")), F.lit("total_tokens"), usage.token_count(F.col("total_tokens"))), lambda _, v: v.isNotNull())
    cost = F.map_filter(F.create_map(F.lit("input"), usage.decimal_cost(F.col("prompt_cost")), F.lit("output"), usage.decimal_cost(F.col("completion_cost")), F.lit("total"), usage.decimal_cost(F.col("total_cost"))), lambda _, v: v.isNotNull())
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    traces = pulled.where("parent_run_id is null").select(
        F.lit(project_id).alias("project_id"), F.col("trace_id").alias("id"), F.to_timestamp("start_time").alias("timestamp"), "name", F.nullif("session_id", F.lit("")).alias("session_id"),
        F.array_distinct(F.concat(tags, F.array(F.lit(IMPORT_TAGS[1])))).alias("tags"), F.col("inputs").alias("input"), F.col("outputs").alias("output"),
    )
    observations = pulled.select(
        F.lit(project_id).alias("project_id"), "id", "trace_id", F.col("parent_run_id").alias("parent_observation_id"), F.when(F.col("run_type") == "llm", "generation").otherwise("span").alias("type"), "name",
        F.to_timestamp("start_time").alias("start_time"), F.to_timestamp("end_time").alias("end_time"), _run_level().alias("level"), F.nullif("error", F.lit("")).alias("status_message"), F.nullif("model", F.lit("")).alias("model"),
        F.col("inputs").alias("input"), F.col("outputs").alias("output"), F.when(F.size(counts) > 0, counts).alias("usage_details"), F.when(F.size(cost) > 0, cost).alias("cost_details"),
    )
    return traces, observations


def map_feedback(pulled: DataFrame, runs: DataFrame, project_id: str) -> DataFrame:
    """Scores of feedback (id, run_id, key, score, value): numbers and text are both kept, neither drops the
    row, and feedback on a root run is on the trace itself."""
    of = runs.select(F.col("id").alias("run_id"), "trace_id", F.col("parent_run_id").isNull().alias("_root"))
    return pulled.where("score is not null or value is not null").join(of, "run_id").select(
        F.lit(project_id).alias("project_id"), "id", "trace_id", F.when(~F.col("_root"), F.col("run_id")).alias("observation_id"), F.col("key").alias("name"),
        F.when(F.col("score").isNotNull(), "numeric").otherwise("categorical").alias("data_type"), F.col("score").cast("double").alias("value"), F.col("value").alias("string_value"),
        F.lit("api").alias("source"), F.lit("langsmith").alias("import_source"), "comment", F.to_timestamp("created_at").alias("timestamp"),
    )


def read_pulled(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of pages that a pull has saved: JSON files of the form {"data": [...], "meta": ...}; ``row`` is the
    DDL of an entry, as ``name:type`` pairs."""
    pages = spark.read.schema(f"data array<struct<{row}>>").option("multiLine", True).json(path)
    return pages.select(F.explode("data").alias("d")).select("d.*")
