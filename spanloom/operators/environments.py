"""Registry of the environments that a project's traces name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.paging import keyset_page

#: Fixed value: names that a project keeps.
CAPACITY = 100


def statistics(traces: DataFrame) -> DataFrame:
    """(project_id, name, first_seen_at, last_seen_at) over live traces."""
    named = traces.where("environment is not null")
    return named.groupBy("project_id", F.col("environment").alias("name")).agg(F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"))


def merged(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """The registry after a batch: earliest and latest times; what is hidden stays hidden."""
    both = registry.unionByName(seen.withColumn("hidden", F.lit(False)))
    return both.groupBy("project_id", "name").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("hidden").alias("hidden"))


def admitted(registry: DataFrame, seen: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Known names, and of the new ones the last seen (then by name) while there is room."""
    known = registry.groupBy("project_id").agg(F.count("*").alias("_known"))
    fresh = seen.join(registry.select("project_id", "name"), ["project_id", "name"], "left_anti")
    order = W.partitionBy("project_id").orderBy(F.desc("last_seen_at"), "name")
    taken = fresh.withColumn("_n", F.row_number().over(order)).join(known, "project_id", "left").where(F.col("_n") <= capacity - F.coalesce("_known", F.lit(0)))
    known_seen = seen.join(registry.select("project_id", "name"), ["project_id", "name"], "left_semi")
    return merged(registry, known_seen.unionByName(taken.drop("_n", "_known")))


def rebuilt(traces: DataFrame, watermark, capacity: int = CAPACITY) -> DataFrame:
    """The registry anew: names seen since the watermark come first, then by recency and name."""
    stats = statistics(traces).withColumn("_fresh", F.col("last_seen_at") >= F.lit(watermark))
    order = W.partitionBy("project_id").orderBy(F.desc("_fresh"), F.desc("last_seen_at"), "name")
    return stats.withColumn("place", F.row_number().over(order)).where(F.col("place") <= capacity).drop("_fresh")


def listing(registry: DataFrame) -> DataFrame:
    return registry.orderBy("hidden", F.desc("last_seen_at"), "name", "project_id")


def set_hidden(registry: DataFrame, project_id: str, name: str, hidden: bool) -> DataFrame:
    here = (F.col("project_id") == project_id) & (F.col("name") == name)
    return registry.withColumn("hidden", F.when(here, F.lit(hidden)).otherwise(F.col("hidden")))


def named_page(traces: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    return keyset_page(traces.where("environment is not null").select("project_id", "environment", "timestamp", "id"), ["timestamp", "id"], limit, after)
