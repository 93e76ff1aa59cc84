"""Raw ingest batches: where they land, how they are read, which of their events concern a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.schemas import INGEST_BATCH

#: Events of a batch at most, and the kinds and sources that an event may have.
MOST_EVENTS = 500
EVENT_TYPES = ("trace-upsert", "observation-upsert", "score-upsert", "otlp-export", "langfuse-ingestion")
EVENT_SOURCES = ("native", "otlp", "langfuse", "import", "evaluator")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch file; ``broken`` holds the text of files that aren't batches."""
    rows = spark.read.schema(f"{INGEST_BATCH}, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("object_key", F.regexp_extract(F.col("_metadata.file_path"), r"(raw/.*)$", 1))


def events(batches: DataFrame) -> DataFrame:
    """(project_id, batch_id, received_at, object_key, ordinal, id, type, source, body): a row per event."""
    good = batches.where("batchId is not null and size(events) between 1 and " + str(MOST_EVENTS))
    each = good.select(F.col("projectId").alias("project_id"), F.col("batchId").alias("batch_id"), F.to_timestamp("receivedAt").alias("received_at"), "object_key", F.posexplode("events").alias("ordinal", "e"))
    return each.select("project_id", "batch_id", "received_at", "object_key", "ordinal", "e.id", "e.type", "e.source", "e.body")


def bad_batches(batches: DataFrame) -> DataFrame:
    """(object_key, message) of files that give no events."""
    why = F.when(F.col("broken").isNotNull() | F.col("batchId").isNull(), "not a batch").when(~F.coalesce(F.size("events").between(1, MOST_EVENTS), F.lit(False)), "no events, or too many")
    return batches.select("object_key", why.alias("message")).where("message is not null")


_OTLP_IDS = "resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<traceId:string>>>>>>"
_COMPAT_IDS = "batch array<struct<type:string,body:struct<id:string,traceId:string>>>"


def concerns(trace_id: Column) -> Column:
    """EXACT, POSSIBLE or NO: whether an event (type, source, body) is about a trace. A request is possibly about
    it if one of its parts doesn't say what it is about, as updates do that leave the trace out."""
    lost = lambda c: F.coalesce(c, F.lit(True))
    some = lambda c: F.coalesce(c, F.lit(False))
    own = F.when(F.col("type") == "trace-upsert", F.get_json_object("body", "$.id")).otherwise(F.get_json_object("body", "$.traceId"))
    parts = F.from_json("body", _OTLP_IDS)["resourceSpans"]
    told = _any_span(parts, lambda x: some(x["traceId"] == trace_id), F.lit(False))
    gaps = _any_span(parts, lambda x: x["traceId"].isNull(), F.lit(True))
    otlp = F.when(some(told), "EXACT").when(lost(gaps), "POSSIBLE").otherwise("NO")
    items = F.from_json("body", _COMPAT_IDS)["batch"]
    of_trace = lambda e: some(e["type"].startswith("trace"))
    named = F.exists(items, lambda e: some(e["body"]["traceId"] == trace_id) | (of_trace(e) & some(e["body"]["id"] == trace_id)))
    unnamed = F.exists(items, lambda e: e["body"]["traceId"].isNull() & ~(of_trace(e) & e["body"]["id"].isNotNull()))
    compat = F.when(some(named), "EXACT").when(lost(unnamed), "POSSIBLE").otherwise("NO")
    return F.when(F.col("type") == "otlp-export", otlp).when(F.col("type") == "langfuse-ingestion", compat).when(some(own == trace_id), "EXACT").otherwise("NO")


def _any_span(parts: Column, test, missing: Column) -> Column:
    """Whether any span of a parsed export passes; a part without spans counts as ``missing``. Null if the body
    is no export."""
    within = lambda a, f: F.when(a.isNull(), missing).otherwise(F.exists(a, f))
    return F.exists(parts, lambda r: within(r["scopeSpans"], lambda s: within(s["spans"], test)))


def land(batches: DataFrame, path: str) -> None:
    """Writes batches (projectId, batchId, receivedAt, events) as files that readers see whole or not at all,
    in folders by project and day."""
    day = F.to_timestamp("receivedAt")
    line = F.to_json(F.struct("batchId", "projectId", "receivedAt", "events"))
    batches.select(F.concat_ws("/", "projectId", F.date_format(day, "yyyy/MM/dd")).alias("at"), line.alias("value")).write.mode("append").partitionBy("at").text(path)


def media_assets(files: DataFrame, known: DataFrame) -> DataFrame:
    """New media (path, content) by what they hold: the first of equal contents, unless it is known."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"), F.col("modificationTime").alias("created_at"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("created_at", "path", "bytes")).alias("f")).select("sha256", "f.*")
    return first.join(known.select("sha256"), "sha256", "left_anti")


def media_totals(assets: DataFrame) -> DataFrame:
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"))


def dead_letters(errors: DataFrame, at) -> DataFrame:
    """Rows for the table of failed events."""
    return errors.select("project_id", "batch_id", "object_key", "event_id", "event_type", "source", F.lit("mapping").alias("stage"), "message", F.lit(at).cast("timestamp").alias("created_at"))


def inventory(objects: DataFrame, pending: DataFrame, failed: DataFrame) -> DataFrame:
    """(state, objects, bytes, oldest) of raw objects (object_key, size, modified_at), by their sidecars."""
    key = ["object_key"]
    marked = objects.join(pending.select(*key).distinct().withColumn("_p", F.lit(True)), key, "left").join(failed.select(*key).distinct().withColumn("_f", F.lit(True)), key, "left")
    state = F.when(F.col("_p"), "pending").when(F.col("_f"), "failed").otherwise("done")
    return marked.groupBy(state.alias("state")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.min("modified_at").alias("oldest"))


def due_objects(objects: DataFrame, cutoff_day: Column) -> DataFrame:
    """Raw objects of whole days before the cutoff's day."""
    return objects.where(text.parse_raw_key(F.col("object_key"))["day"] < cutoff_day)
