"""Costs from usage: price lookup by override pattern or by candidate names, exact decimals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.attributes import let

#: Providers whose prefix a table may carry, in the order they are tried.
PROVIDERS = (
    "openai", "anthropic", "gemini", "vertex_ai", "bedrock", "azure", "mistral", "groq", "deepseek", "xai", "cohere", "together_ai", "fireworks_ai", "openrouter",
)
#: Which usage key each price is for.
COMPONENTS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
#: Metadata keys that say where a derived cost came from: source, matched key, table date.
PROVENANCE = ("spanloom:cost_source", "spanloom:cost_model", "spanloom:cost_table")


def candidates(model: Column) -> Column:
    """Names to look a model up by, in order: as sent, lower-cased, without provider, without date or
    ``latest``, then each of those behind every provider."""
    def spread(names: Column, plain: Column) -> Column:
        behind = F.flatten(F.transform(F.array(*map(F.lit, PROVIDERS)), lambda p: F.transform(plain, lambda n: F.concat(p, F.lit("/"), n))))
        return F.array_distinct(F.concat(names, behind))

    def named(trimmed: Column, low: Column, bare: Column) -> Column:
        cut = [F.regexp_replace(F.regexp_replace(n, pattern, ""), r"^\s+|\s+$", "") for n in (low, bare) for pattern in (r"[-@]([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$", "[-:]latest$")]
        return F.array_distinct(F.filter(F.array(trimmed, low, bare, *cut), lambda n: n != ""))

    without = lambda low: F.when(F.contains(low, F.lit("/")), F.regexp_replace(low, r"^[^/]*/", "")).otherwise(low)
    names = let(F.regexp_replace(model, r"^\s+|\s+$", ""), lambda t: let(F.lower(t), lambda low: let(without(low), lambda bare: named(t, low, bare))))
    return let(names, lambda all_: let(F.filter(all_, lambda n: ~F.contains(n, F.lit("/"))), lambda plain: spread(all_, plain)))


def usable_overrides(rows: list[tuple]) -> list[tuple]:
    """The (project_id, position, pattern, input, output, cache_read, cache_write) whose pattern compiles in the engine
    that matches it. Needs a session."""
    java = SparkSession.getActiveSession()._jvm.java.util.regex.Pattern
    out = []
    for r in rows:
        try:
            java.compile(r[2])
        except IllegalArgumentException:
            continue
        out.append(r)
    return out


def _well_formed(patterns: pd.Series) -> pd.Series:
    def fine(p: object) -> bool:
        try:
            re.compile(p)
        except (re.error, TypeError):
            return False
        return True

    return patterns.map(fine)


def ordered_overrides(rules: DataFrame) -> DataFrame:
    """(project_id, position, pattern) of (project_id, ordinal, pattern): a project's rules in their order, counted
    from 0; a pattern that isn't well formed takes no place. A project's rules are a list that a person keeps."""
    compiled = F.pandas_udf(_well_formed, "boolean")
    order = W.partitionBy("project_id").orderBy("ordinal")
    return rules.where(compiled("pattern")).select("project_id", (F.row_number().over(order) - 1).alias("position"), "pattern")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price list as JSON: {"syncedAt": ..., "models": {name: {provider, input, output, cache_read, cache_write}}}."""
    entry = "provider:string," + ",".join(f"{c}:decimal(24,15)" for c in COMPONENTS)
    listed = spark.read.schema(f"syncedAt string, models map<string,struct<{entry}>>").option("multiLine", True).json(path)
    return listed.select(F.col("syncedAt").alias("synced_at"), F.explode("models").alias("model", "p")).select("model", "p.*", "synced_at")


def _prices() -> Column:
    return F.struct(*COMPONENTS)


def resolve(models: DataFrame, overrides: DataFrame, prices: DataFrame) -> DataFrame:
    """(project_id, model, source, matched, table_version, price) of distinct (project_id, model).

    The project's first matching override wins (by position, patterns found anywhere, case ignored), else the
    first candidate in the table. Both tables are small lists that people keep."""
    asked = models.select("project_id", "model").where("model is not null and model <> ''").distinct()
    rules = overrides.select("project_id", "position", "pattern", _prices().alias("price"))
    ruled = asked.join(F.broadcast(rules), "project_id").where(F.expr("model rlike concat('(?i)', pattern)"))
    first = ruled.groupBy("project_id", "model").agg(F.min_by(F.struct("pattern", "price"), "position").alias("rule"))
    listed = prices.select(F.col("model").alias("name"), F.col("synced_at").alias("table_version"), _prices().alias("price"))
    tried = asked.select("project_id", "model", F.posexplode(candidates(F.col("model"))).alias("place", "name")).join(F.broadcast(listed), "name")
    found = tried.groupBy("project_id", "model").agg(F.min_by(F.struct("name", "table_version", "price"), "place").alias("entry"))
    both = asked.join(first, ["project_id", "model"], "left").join(found, ["project_id", "model"], "left").where("rule is not null or entry is not null")
    ours = F.col("rule").isNotNull()
    return both.select(
        "project_id", "model", F.when(ours, "override").otherwise("table").alias("source"), F.when(ours, F.col("rule.pattern")).otherwise(F.col("entry.name")).alias("matched"),
        F.when(~ours, F.col("entry.table_version")).alias("table_version"), F.when(ours, F.col("rule.price")).otherwise(F.col("entry.price")).alias("price"),
    )


def cost_details(usage: Column, price: Column) -> Column:
    """Components that have both tokens and a price, and their total; null if there is none."""
    parts = [
        F.struct(F.lit(c).alias("key"), F.round(F.try_element_at(usage, F.lit(k)).cast("decimal(20,0)") * price[c].cast("decimal(18,12)"), 9).cast("decimal(18,9)").alias("value"))
        for c, k in COMPONENTS.items()
    ]
    priced = F.filter(F.array(*parts), lambda e: e["value"].isNotNull())
    total = F.aggregate(priced, F.lit(0).cast("decimal(18,9)"), lambda a, e: (a + e["value"]).cast("decimal(18,9)"))
    whole = F.array(F.struct(F.lit("total").alias("key"), total.alias("value")))
    return F.when(F.size(priced) > 0, F.map_from_entries(F.concat(priced, whole)))


def enrich(observations: DataFrame, overrides: DataFrame, prices: DataFrame) -> DataFrame:
    """Derives the cost of observations that have a model and usage but no cost, and notes in their
    metadata where it came from."""
    bare = F.coalesce(F.size("cost_details") <= 0, F.lit(True)) & (F.col("model") != "") & F.coalesce(F.size("usage_details") > 0, F.lit(False))
    found = resolve(observations.where(bare), overrides, prices)
    joined = observations.join(found, ["project_id", "model"], "left")  # clients choose the names: their number decides how
    derived = F.when(bare, cost_details(F.col("usage_details"), F.col("price")))
    notes = F.map_filter(F.create_map(F.lit(PROVENANCE[0]), "source", F.lit(PROVENANCE[1]), "matched", F.lit(PROVENANCE[2]), "table_version"), lambda _, v: v.isNotNull())
    others = F.map_filter("metadata", lambda k, _: ~k.isin(*PROVENANCE))
    return joined.withColumn("_cost", derived).withColumns({
        "metadata": F.when(F.col("_cost").isNotNull(), F.map_concat(others, notes)).otherwise(F.col("metadata")), "cost_details": F.coalesce("_cost", "cost_details"),
    }).select(*observations.columns)
