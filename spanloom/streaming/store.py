"""Stored tables by month and by a hash of (project, trace), with a written map from keys to months.

The rows of one trace lie in one bucket of each month. Who asks for some traces reads the map's buckets of these
traces, gets the (month, bucket) folders that can hold them, and opens these alone: what a micro-batch reads
grows with the batch and not with what is stored. The map is written before the rows, so that it is never short.
Rows are versions, hence a row that stands twice counts once: compaction writes the newest versions beside the old
files before it deletes these, and a failure between the two loses nothing.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import versions
from spanloom.schemas import SORT_TIME, TABLES, require_utc, struct_of
from spanloom.streaming.ledger import Files

FIELD_TIMES = "kind string, project_id string, trace_id string, id string, sent_at map<string,timestamp>, event_ts timestamp, seq bigint"
FEED = "project_id string, trace_id string, activity_id string, version timestamp, published_at timestamp"
SCORE_FEED = "project_id string, trace_id string, published_at timestamp"
KEYED = {**TABLES, "field_times": FIELD_TIMES, "trace_feed": FEED, "score_feed": SCORE_FEED}
#: The column whose month is the partition; times of fields aren't parted by months.
MONTH = {**SORT_TIME, "trace_feed": "published_at", "score_feed": "published_at", "field_times": None}
#: Keys of one question that are pushed down to the map's files; beyond that they are joined only.
PUSHED = 1000


def trace_of(kind: str) -> Column:
    """The trace that a row belongs to."""
    if kind == "traces":
        return F.col("id")
    return F.when(F.col("kind") == "trace", F.col("id")).otherwise(F.col("trace_id")) if kind == "field_times" else F.col("trace_id")


class Store:
    """The tables under one folder. ``read`` gives an empty table where nothing was written. The number of buckets
    is fixed when the folder is first used: as many as leave a bucket of a month a few files of fair size."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        require_utc(spark)
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.files.create(self.at("_buckets"), str(buckets))
        self.buckets = int(self.files.text(self.at("_buckets")))

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def staged(self, df: DataFrame, batch: str) -> DataFrame:
        """The rows as a table of the batch's own: events are parsed once, plans stay short, and what a lost
        executor did isn't done again."""
        at = self.at(f"{batch}/{uuid.uuid4().hex}")
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def forget(self, batch: str) -> None:
        self.files.delete(self.at(batch))

    def _empty(self, ddl: str) -> DataFrame:
        return self.spark.createDataFrame([], struct_of(ddl))

    def read(self, name: str, ddl: str | None = None) -> DataFrame:
        """The whole table."""
        ddl = ddl or KEYED[name]
        if not self.files.exists(self.at(name)):
            return self._empty(ddl)
        return self.spark.read.schema(ddl).parquet(self.at(name)).select(*struct_of(ddl).names)

    def read_since(self, kind: str, since: datetime | None) -> DataFrame:
        """The rows from the time ``since`` on: only folders of its month and later ones are opened."""
        if since is None:
            return self.read(kind)
        there = [self.at(f"{kind}/month={m}") for m in self.months(kind) if m >= since.strftime("%Y-%m")]
        if not there:
            return self._empty(KEYED[kind])
        rows = self.spark.read.schema(KEYED[kind]).option("basePath", self.at(kind)).parquet(*there).select(*struct_of(KEYED[kind]).names)
        return rows.where(F.col(MONTH[kind]) >= F.lit(since))

    def _hashed(self, trace: Column) -> tuple[Column, Column]:
        key = F.xxhash64("project_id", trace)
        return key.alias("key"), F.pmod(key, F.lit(self.buckets)).cast("int").alias("bucket")

    def places(self, kind: str, traces: DataFrame) -> list[tuple[str, int]]:
        """(month, bucket) folders that can hold rows of ``traces`` (project_id, trace_id): as many as the table has
        at most, however many traces are asked for."""
        asked = traces.select(*self._hashed(F.col("trace_id"))).distinct()
        wanted = {r.bucket for r in asked.select("bucket").distinct().collect()}
        root = self.at(f"_keys/{kind}")
        there = [f"{root}/{n}" for n, folder, _ in self.files.listed(root) if folder and int(n.split("=")[1]) in wanted]
        if not there:
            return []
        known = self.spark.read.schema("key bigint, month string, bucket int").option("basePath", root).parquet(*there)
        few = [r.key for r in asked.select("key").limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            known = known.where(F.col("key").isin(few))
        found = known.join(asked, ["bucket", "key"], "left_semi").select("month", "bucket").distinct().collect()
        return sorted((r.month, r.bucket) for r in found)

    def of_traces(self, kind: str, traces: DataFrame) -> DataFrame:
        """All stored rows of ``traces`` (project_id, trace_id), from the folders that can hold them."""
        there = [p for p in (self.at(f"{kind}/month={m}/bucket={b}") for m, b in self.places(kind, traces)) if self.files.exists(p)]
        if not there:
            return self._empty(KEYED[kind])
        rows = self.spark.read.schema(KEYED[kind]).option("basePath", self.at(kind)).parquet(*there).select(*struct_of(KEYED[kind]).names)
        asked = traces.select(F.col("project_id").alias("_project"), F.col("trace_id").alias("_trace")).distinct()
        return rows.join(asked, (rows.project_id == F.col("_project")) & (trace_of(kind) == F.col("_trace")), "left_semi")

    def append(self, kind: str, rows: DataFrame) -> None:
        """Adds rows. They are evaluated twice, so they are to be staged."""
        names = struct_of(KEYED[kind])
        own = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names]
        month = F.date_format(MONTH[kind], "yyyy-MM") if MONTH[kind] else F.lit("all")
        keyed = rows.select(*own).withColumn("month", F.coalesce(month, F.lit("none"))).select("*", *self._hashed(trace_of(kind)))
        new = keyed.select("key", "month", "bucket").distinct()
        root = self.at(f"_keys/{kind}")
        wanted = {r.bucket for r in new.select("bucket").distinct().collect()}
        there = [f"{root}/{n}" for n, folder, _ in self.files.listed(root) if folder and int(n.split("=")[1]) in wanted]
        if there:
            known = self.spark.read.schema("key bigint, month string, bucket int").option("basePath", root).parquet(*there)
            new = new.join(known, ["bucket", "key", "month"], "left_anti")
        new.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(root)
        order = ["project_id", *([MONTH[kind]] if MONTH[kind] else []), trace_of(kind)]
        self._write(keyed.drop("key"), kind, order)

    def _write(self, rows: DataFrame, kind: str, order: list) -> None:
        out = rows.repartition("month", "bucket").sortWithinPartitions("month", "bucket", *order)
        out.write.mode("append").partitionBy("month", "bucket").option("compression", "zstd").parquet(self.at(kind))

    def _folders(self, kind: str, least_files: int) -> tuple[list[str], list[str]]:
        """Folders with so many files, and these files."""
        found, files = [], []
        for month, folder, _ in self.files.listed(self.at(kind)):
            for bucket, _, _ in self.files.listed(self.at(f"{kind}/{month}")) if folder else []:
                at = self.at(f"{kind}/{month}/{bucket}")
                mine = [f"{at}/{n}" for n, _, _ in self.files.listed(at) if n.endswith(".parquet")]
                if len(mine) >= least_files:
                    found.append(at)
                    files += mine
        return found, files

    def _replace(self, kind: str, change, least_files: int = 1) -> int:
        """Puts ``change`` of the rows of the folders in the place of their files. New files stand before old ones go."""
        folders, old = self._folders(kind, least_files)
        if folders:
            rows = self.spark.read.schema(f"{KEYED[kind]}, month string, bucket int").option("basePath", self.at(kind)).parquet(*folders)
            self._write(change(rows), kind, ["project_id", *([MONTH[kind]] if MONTH[kind] else []), trace_of(kind)])
            for path in old:
                self.files.delete(path)
        return len(folders)

    def compact(self, kind: str, tombstones_since: datetime, least_files: int = 8) -> int:
        """Puts the newest versions of every folder of ``least_files`` and more into one file, tombstones with them
        while older versions may still come. The number of folders. One writer at a time; who reads an old file
        meanwhile has to ask again."""

        def newest(rows: DataFrame) -> DataFrame:
            if kind == "field_times":
                key = ["month", "bucket", "kind", "project_id", "trace_id", "id"]
                return rows.groupBy(*key).agg(F.max_by(F.struct("sent_at", "event_ts", "seq"), F.struct("event_ts", "seq")).alias("n")).select(*key, "n.*")
            if kind == "trace_feed":
                return rows.groupBy("project_id", "trace_id", "activity_id", "month", "bucket").agg(F.min_by(F.struct("version", "published_at"), "published_at").alias("n")).select("*", "n.*").drop("n")
            if kind == "score_feed":
                return rows.groupBy("project_id", "trace_id", "month", "bucket").agg(F.max("published_at").alias("published_at"))
            return versions.compact(rows, kind, tombstones_since)

        return self._replace(kind, newest, least_files)

    def prune(self, kind: str, gone: DataFrame) -> int:
        """Takes the rows of the traces in ``gone`` (project_id, trace_id) out for good. Tables of few rows only."""
        traces = gone.select(F.col("project_id").alias("_project"), F.col("trace_id").alias("_trace")).distinct()
        return self._replace(kind, lambda rows: rows.join(traces, (rows.project_id == F.col("_project")) & (trace_of(kind) == F.col("_trace")), "left_anti"))

    def months(self, kind: str) -> list[str]:
        return sorted(n.split("=")[1] for n, folder, _ in self.files.listed(self.at(kind)) if folder and n.startswith("month="))

    def drop_month(self, kind: str, month: str) -> bool:
        """Drops a month's folder. The map keeps its keys: it may name more folders than there are."""
        return self.files.delete(self.at(f"{kind}/month={month}"))
