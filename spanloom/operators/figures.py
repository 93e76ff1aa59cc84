"""Exact figures of observations, traces and sets of traces. Absent is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.time import duration_ms

#: Key names in the order in which summaries look for them.
INPUT_KEYS, OUTPUT_KEYS, TOTAL_KEYS = ("input_tokens", "input"), ("output_tokens", "output"), ("total_tokens", "total")


def reported(details: Column) -> Column:
    """Whether the map has any entry."""
    return F.coalesce(F.size(details) > 0, F.lit(False))


def observation_cost(cost: Column) -> Column:
    """``total`` if it is there, else the sum of all components; an empty map costs 0."""
    zero = F.lit(0).cast("decimal(28,9)")
    added = F.aggregate(F.map_values(cost), zero, lambda a, v: (a + v).cast("decimal(28,9)"))
    return F.coalesce(F.try_element_at(cost, F.lit("total")).cast("decimal(28,9)"), added, zero)


def observation_tokens(usage: Column) -> Column:
    zero = F.lit(0).cast("decimal(20,0)")
    of = lambda key: F.try_element_at(usage, F.lit(key))
    return F.coalesce(of("total_tokens"), F.coalesce(of("input_tokens"), zero) + F.coalesce(of("output_tokens"), zero)).cast("decimal(28,0)")


def figured(observations: DataFrame) -> DataFrame:
    """The observations with ``cost`` and ``tokens``, null where none are reported, in the place of their maps, which are
    wider. May come before versions collapse."""
    for name, details, figure in (("cost", "cost_details", observation_cost), ("tokens", "usage_details", observation_tokens)):
        if details in observations.columns:
            observations = observations.withColumn(name, F.when(reported(F.col(details)), figure(F.col(details)))).drop(details)
    return observations


def trace_metrics(observations: DataFrame) -> DataFrame:
    """A row per trace over live observations, as they are or ``figured``: duration_ms, total_cost, total_tokens,
    error_count, models."""
    observations = figured(observations) if "cost_details" in observations.columns else observations
    return observations.groupBy("project_id", F.col("trace_id").alias("id")).agg(
        duration_ms(F.min("start_time"), F.max("end_time")).alias("duration_ms"),
        F.sum("cost").alias("total_cost"),
        F.sum("tokens").alias("total_tokens"),
        F.count_if(F.col("level") == "error").alias("error_count"),
        F.array_sort(F.collect_set("model")).alias("models"),
    )


def with_metrics(page: DataFrame, metrics: DataFrame) -> DataFrame:
    """Page rows with their figures: counts default to 0, lists to empty, the rest stays null."""
    joined = page.join(metrics, ["project_id", "id"], "left")
    return joined.withColumns({"error_count": F.coalesce("error_count", F.lit(0)), "models": F.coalesce("models", F.array().cast("array<string>"))})


def map_totals(observations: DataFrame, column: str) -> DataFrame:
    """(key, total) of a map column; an absent key isn't a zero."""
    return observations.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def latency_percentiles(observations: DataFrame, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: exact percentiles of the durations of traces that have an end; nulls if there is none."""
    each = observations.groupBy("project_id", "trace_id").agg(F.min("start_time").alias("start"), F.max("end_time").alias("end"))
    ended = each.where("end is not null").select(duration_ms(F.col("start"), F.col("end")).alias("ms"))
    names = [f"p{round(q * 100)}" for q in at]
    return ended.agg(F.percentile("ms", F.array(*map(F.lit, at))).alias("p")).select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def aggregates(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """One row for a matched set: trace_count, token and cost totals as maps, latency percentiles."""
    as_map = lambda df, name: df.agg(F.map_from_entries(F.collect_list(F.struct("key", "total"))).alias(name))  # noqa: E731  a row per key name
    out = traces.agg(F.count("*").alias("trace_count"))
    for part in (as_map(map_totals(observations, "usage_details"), "tokens"), as_map(map_totals(observations, "cost_details"), "costs"), latency_percentiles(observations)):
        out = out.unionByName(part, allowMissingColumns=True)  # one row each
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def first_key(totals: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(totals, F.lit(k)) for k in keys])


def summary(totals: Column) -> Column:
    """A map of totals as one number: the total if named, else input plus output, else all entries."""
    one, two = first_key(totals, INPUT_KEYS), first_key(totals, OUTPUT_KEYS)
    both = F.when(one.isNotNull() | two.isNotNull(), F.coalesce(one, F.lit(0)) + F.coalesce(two, F.lit(0))).cast("decimal(38,9)")
    everything = F.when(F.size(totals) > 0, F.aggregate(F.map_values(totals), F.lit(0).cast("decimal(38,9)"), lambda a, v: (a + v).cast("decimal(38,9)")))
    return F.coalesce(first_key(totals, TOTAL_KEYS).cast("decimal(38,9)"), both, everything)


def kpi_tiles(figures: DataFrame) -> DataFrame:
    """(tile, value) of the one row that ``aggregates`` gives."""
    tiles = {"traces": F.col("trace_count").cast("double"), "tokens": summary(F.col("tokens")).cast("double"), "cost": summary(F.col("costs")).cast("double"), "latency": F.col("p95")}
    return figures.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tile"), v.alias("value")) for k, v in tiles.items()])).alias("t")).select("t.*")
