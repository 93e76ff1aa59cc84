"""Native events: bodies are the domain's own objects. A bad event becomes an error; the others go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text, usage

_META = "map<string,string>"
TRACE_BODY = f"id string, timestamp string, name string, userId string, sessionId string, environment string, release string, version string, tags array<string>, metadata {_META}"
OBSERVATION_BODY = f"id string, traceId string, parentObservationId string, type string, name string, startTime string, endTime string, level string, statusMessage string, model string, completionStartTime string, usageDetails map<string,double>, costDetails map<string,decimal(18,9)>, metadata {_META}"
SCORE_BODY = f"id string, traceId string, observationId string, name string, dataType string, value double, stringValue string, source string, comment string, timestamp string, metadata {_META}"
TYPES = {"trace-upsert": TRACE_BODY, "observation-upsert": OBSERVATION_BODY, "score-upsert": SCORE_BODY}
FACTS = ["project_id", "batch_id", "object_key", "received_at", "ordinal"]


def _time(column: str) -> Column:
    return F.try_to_timestamp(F.col(column))


def payload(name: str) -> Column:
    """A payload stays text: absent is null, a sent null is the text ``null``."""
    return F.to_json(F.try_variant_get("v", f"$.{name}", "variant"))


def _parsed(events: DataFrame, kind: str) -> DataFrame:
    mine = events.where((F.col("source") == "native") & (F.col("type") == kind))
    known = F.struct(F.from_json("body", TYPES[kind]).alias("b"), F.try_parse_json("body").alias("v"), text.parsed(F.col("body")).isNull().alias("broken"))
    # a generator keeps the optimiser from parsing the body anew for every field that is asked for
    once = mine.select(*FACTS, F.col("id").alias("event_id"), "source", F.explode(F.array(known)).alias("p"))
    return once.select(*FACTS, "event_id", "source", "p.b", "p.v", "p.broken")


def _checks(kind: str) -> list[tuple[Column, str]]:
    b = lambda f: F.col(f"b.{f}")
    wrong_id = lambda f: text.identifier(b(f)).isNull()
    not_time = lambda f: b(f).isNotNull() & F.try_to_timestamp(b(f)).isNull()
    none = F.col("b").isNull() | F.col("broken")
    if kind == "trace-upsert":
        return [(none, "body is no object"), (wrong_id("id"), "id is missing or invalid"), (F.try_to_timestamp(b("timestamp")).isNull(), "timestamp is missing or invalid")]
    if kind == "observation-upsert":
        return [
            (none, "body is no object"), (wrong_id("id"), "id is missing or invalid"), (wrong_id("traceId"), "traceId is missing or invalid"), (F.try_to_timestamp(b("startTime")).isNull(), "startTime is missing or invalid"), (not_time("endTime"), "endTime is invalid"),
            (~F.coalesce(b("type").isin(*text.TYPES), F.lit(False)), "type is unknown"), (b("level").isNotNull() & ~b("level").isin(*text.LEVELS), "level is unknown"),
            (F.exists(F.map_values(b("usageDetails")), lambda v: (v < 0) | (v != F.floor(v))), "usageDetails holds no counts"),
        ]
    return [
        (none, "body is no object"), (wrong_id("id"), "id is missing or invalid"), (wrong_id("traceId"), "traceId is missing or invalid"), (F.coalesce(b("name"), F.lit("")) == "", "name is missing"),
        (~F.coalesce(b("source").isin(*text.SOURCES), F.lit(False)), "source is unknown"), (b("value").isNull() & b("stringValue").isNull(), "score requires value or stringValue"), (not_time("timestamp"), "timestamp is invalid"),
    ]


def _judged(events: DataFrame, kind: str) -> DataFrame:
    message = F.lit(None).cast("string")
    for wrong, why in reversed(_checks(kind)):
        message = F.when(F.coalesce(wrong, F.lit(False)), why).otherwise(message)
    return _parsed(events, kind).withColumn("message", message)


def errors(events: DataFrame) -> DataFrame:
    """(project_id, batch_id, object_key, event_id, event_type, source, message) of events that don't map."""
    parts = [_judged(events, k).where("message is not null").select("project_id", "batch_id", "object_key", "event_id", F.lit(k).alias("event_type"), "source", "message") for k in TYPES]
    unknown = events.where((F.col("source") == "native") & ~F.col("type").isin(*TYPES)).select("project_id", "batch_id", "object_key", F.col("id").alias("event_id"), F.col("type").alias("event_type"), "source", F.lit("type is unknown").alias("message"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(unknown)


def _some(name: str) -> Column:
    return F.nullif(F.col(f"b.{name}"), F.lit(""))


_NO_MAP = "cast(map() as map<string,string>)"


def traces(events: DataFrame) -> DataFrame:
    """Trace rows; an invalid environment is dropped and the trace kept."""
    return _judged(events, "trace-upsert").where("message is null").select(
        *FACTS, text.identifier(F.col("b.id")).alias("id"), _time("b.timestamp").alias("timestamp"), _some("name").alias("name"), _some("userId").alias("user_id"), _some("sessionId").alias("session_id"),
        text.environment(F.col("b.environment")).alias("environment"), _some("release").alias("release"), _some("version").alias("version"), F.coalesce("b.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("b.metadata", F.expr(_NO_MAP)).alias("metadata"), payload("input").alias("input"), payload("output").alias("output"),
    )


def observations(events: DataFrame) -> DataFrame:
    counts = F.transform_values(usage.canonical(F.col("b.usageDetails")), lambda _, v: v.cast("decimal(20,0)"))
    return _judged(events, "observation-upsert").where("message is null").select(
        *FACTS, text.identifier(F.col("b.id")).alias("id"), text.identifier(F.col("b.traceId")).alias("trace_id"), _some("parentObservationId").alias("parent_observation_id"), "b.type", _some("name").alias("name"),
        _time("b.startTime").alias("start_time"), _time("b.endTime").alias("end_time"), F.coalesce("b.level", F.lit("default")).alias("level"), _some("statusMessage").alias("status_message"), _some("model").alias("model"),
        counts.alias("usage_details"), F.col("b.costDetails").alias("cost_details"), _time("b.completionStartTime").alias("completion_start_time"), F.coalesce("b.metadata", F.expr(_NO_MAP)).alias("metadata"),
        payload("input").alias("input"), payload("output").alias("output"),
    )


def scores(events: DataFrame) -> DataFrame:
    """Score rows; without a time of their own they take the batch's."""
    kind = F.coalesce("b.dataType", text.score_type(F.col("b.value"), F.col("b.stringValue")))
    return _judged(events, "score-upsert").where("message is null").select(
        *FACTS, text.identifier(F.col("b.id")).alias("id"), text.identifier(F.col("b.traceId")).alias("trace_id"), _some("observationId").alias("observation_id"), "b.name", kind.alias("data_type"), "b.value",
        F.col("b.stringValue").alias("string_value"), "b.source", _some("comment").alias("comment"), F.coalesce(_time("b.timestamp"), F.col("received_at")).alias("timestamp"), F.coalesce("b.metadata", F.expr(_NO_MAP)).alias("metadata"),
    )
