"""Versioned tables: the highest version of a key wins, and a tombstone hides the key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.time import shift_micros
from spanloom.schemas import RECORD, SORT_TIME, TABLES, struct_of


def key_of(kind: str) -> list[Column]:
    return [F.col("project_id"), F.to_date(SORT_TIME[kind]), *map(F.col, RECORD[kind])]


def _newest(key: list) -> W:
    return W.partitionBy(*key).orderBy(F.desc("event_ts"), F.desc("seq"))


def latest(df: DataFrame, kind: str, deleted: bool = False) -> DataFrame:
    """One row per key, the newest; keys whose newest row is a tombstone go unless ``deleted``.

    Only key columns may be filtered before this. Of equal versions the higher ``seq`` (the later
    insert) wins. Rows are dealt by trace before they are ranked: a task sorts its share of the shuffle and never
    a whole split of the input, and joins and groupings by trace after this move nothing again."""
    ranked = df.repartition("project_id", RECORD[kind][0]).withColumn("_rank", F.row_number().over(_newest(key_of(kind)))).where("_rank = 1").drop("_rank")
    return ranked if deleted else ranked.where(~F.col("is_deleted"))


def latest_by_id(df: DataFrame, kind: str) -> DataFrame:
    """One live row per record, the newest over all its days."""
    live = latest(df, kind)
    key = ["project_id", *RECORD[kind]]
    return live.withColumn("_rank", F.row_number().over(_newest(key))).where("_rank = 1").drop("_rank")


def of_ids(df: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Newest live row of each asked record; ``ids`` has project_id and the record's columns."""
    return latest_by_id(df.join(ids, ["project_id", *RECORD[kind]], "left_semi"), kind)


def existing_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    live = latest(df.join(ids, ["project_id", "id"], "left_semi"), "traces")
    return live.select("project_id", "id").distinct()


def stored_row_keys(traces: DataFrame, observations: DataFrame, scores: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, project_id, trace_id, id, sort_time, event_ts): every live row, on whatever day, of the asked
    (kind, project_id, trace_id, id); a trace's trace_id is ''."""
    parts = []
    for kind, df in (("traces", traces), ("observations", observations), ("scores", scores)):
        df = df.withColumn("trace_id", F.lit("")) if kind == "traces" else df
        asked = records.where(F.col("kind") == kind[:-1]).select("project_id", "trace_id", "id")
        live = latest(df.join(asked, ["project_id", "trace_id", "id"], "left_semi"), kind)
        parts.append(live.select(F.lit(kind[:-1]).alias("kind"), "project_id", "trace_id", "id", F.col(SORT_TIME[kind]).alias("sort_time"), "event_ts"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tombstones(df: DataFrame, at: Column | datetime) -> DataFrame:
    """Deleting versions of the rows, as of ``at``; payloads are left empty."""
    at = at if isinstance(at, Column) else F.lit(at)
    empty = {c: F.lit(None).cast(df.schema[c].dataType) for c in ("input", "output") if c in df.columns}
    return df.withColumns({**empty, "event_ts": at.cast("timestamp"), "is_deleted": F.lit(True)})


def replace_snapshot(stored: DataFrame, fresh: DataFrame, at: datetime, kind: str) -> DataFrame:
    """Versions that put an import's ``fresh`` rows in the place of the ``stored`` live ones: tombstones come
    a microsecond before, so that a row in both stays."""
    at_ = F.lit(at).cast("timestamp")
    return tombstones(latest(stored, kind), shift_micros(at_, -1)).unionByName(fresh.withColumn("event_ts", at_), allowMissingColumns=True)


def expire_snapshot(stored: DataFrame, at: datetime, kind: str) -> DataFrame:
    """Tombstones a microsecond after ``at``, so that they win over rows of the same import."""
    return tombstones(latest(stored, kind), shift_micros(F.lit(at).cast("timestamp"), 1))


def replace_scores(stored: DataFrame, fresh: DataFrame, source: str, at: datetime) -> DataFrame:
    """Score-only import: only scores of that import source are replaced."""
    return replace_snapshot(latest(stored, "scores").where(F.col("import_source") == source), fresh, at, "scores")


def compact(df: DataFrame, kind: str, tombstones_since: datetime) -> DataFrame:
    """The newest version of each key; tombstones stay while older versions may still arrive."""
    return latest(df, kind, deleted=True).where(~F.col("is_deleted") | (F.col("event_ts") >= F.lit(tombstones_since)))


def append(df: DataFrame, path: str, kind: str) -> None:
    """Appends versions, partitioned by month and clustered by key."""
    columns = [df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in struct_of(TABLES[kind])]
    month = F.date_format(SORT_TIME[kind], "yyyy-MM")
    out = df.select(*columns).withColumn("month", month).repartition("month", F.pmod(F.xxhash64("project_id", *RECORD[kind]), F.lit(8)))
    out.sortWithinPartitions("project_id", SORT_TIME[kind], *RECORD[kind]).write.mode("append").partitionBy("month").option("compression", "zstd").parquet(path)


def months(df: DataFrame, kind: str) -> DataFrame:
    """(month, first, last): the partitions and the range of their times."""
    time = SORT_TIME[kind]
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.min(time).alias("first"), F.max(time).alias("last"))
