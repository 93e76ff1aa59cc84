"""Index of raw objects by trace: references go pending, applied, expired and never back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States of a reference.
PENDING, APPLIED, EXPIRED = 0, 1, 2
KEY = ["project_id", "trace_id", "object_key"]


def states(refs: DataFrame) -> DataFrame:
    """(key, applied, received_at): each reference's furthest state and first receipt."""
    return refs.groupBy(*KEY).agg(F.max("applied").alias("applied"), F.min("received_at").alias("received_at"))


def applied(refs: DataFrame) -> DataFrame:
    return states(refs).where(F.col("applied") == APPLIED)


def pending(refs: DataFrame) -> DataFrame:
    return states(refs).where(F.col("applied") == PENDING)


def expired(refs: DataFrame) -> DataFrame:
    return states(refs).where(F.col("applied") == EXPIRED)


def pending_traces(refs: DataFrame) -> DataFrame:
    return pending(refs).groupBy("project_id", "trace_id").agg(F.count("*").alias("pending"))


def trace_index(refs: DataFrame, limit: int) -> DataFrame:
    """Applied objects of each trace in order of receipt, ``limit + 1`` at most."""
    order = W.partitionBy("project_id", "trace_id").orderBy("received_at", "object_key")
    return applied(refs).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)


def new_refs(refs: DataFrame, state: int = PENDING) -> DataFrame:
    return refs.dropDuplicates(KEY).withColumn("applied", F.lit(state).cast("tinyint"))


def expire(refs: DataFrame, objects: DataFrame, at) -> DataFrame:
    """Versions that expire the references of the given (project_id, object_key)."""
    return states(refs).join(objects, ["project_id", "object_key"], "left_semi").withColumns({"applied": F.lit(EXPIRED).cast("tinyint"), "event_ts": F.lit(at)})


def visible(traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Traces of which any live row is left in any table."""
    ids = [traces.select("project_id", F.col("id").alias("trace_id")), *[d.select("project_id", "trace_id") for d in (observations, scores)]]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


def within_caps(objects: DataFrame, most_objects: int, most_bytes: int) -> DataFrame:
    """Each trace's objects up to the caps on their number and summed size, ``truncated`` telling why the
    rest is left out."""
    order = W.partitionBy("project_id", "trace_id").orderBy("received_at", "object_key")
    so_far = objects.withColumns({"_n": F.row_number().over(order), "_bytes": F.sum("size").over(order)})
    why = F.when(F.col("_n") > most_objects, "object_limit").when(F.col("_bytes") > most_bytes, "byte_limit")
    return so_far.withColumn("truncated", why).drop("_n", "_bytes")
