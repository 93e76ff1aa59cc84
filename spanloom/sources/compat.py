"""Compatible ingestion requests: create and update events of one record are merged before they map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text, usage
from spanloom.operators.moved import fold_fields, last_sent
from spanloom.schemas import COMPAT_REQUEST

#: Event types by what they are about.
KINDS = {
    "trace-create": "trace", "span-create": "span", "span-update": "span", "generation-create": "generation", "generation-update": "generation", "event-create": "event", "observation-create": "span",
    "observation-update": "span", "score-create": "score", "sdk-log": "log",
}
TRACE_FIELDS = ("timestamp", "name", "userId", "sessionId", "environment", "release", "version", "tags", "metadata", "input", "output")
OBSERVATION_FIELDS = ("traceId", "parentObservationId", "name", "startTime", "endTime", "completionStartTime", "level", "statusMessage", "model", "modelParameters", "metadata", "input", "output", "usage", "usageDetails", "costDetails")


def events(batches: DataFrame) -> DataFrame:
    """(project_id, batch_id, received_at, ordinal, place, event_id, sent_at, type, kind, key, body) of the
    requests in a batch. ``key`` names the record; an event without a body id is a record of its own."""
    mine = batches.where("source = 'langfuse'").select("project_id", "batch_id", "received_at", "ordinal", F.from_json("body", COMPAT_REQUEST).alias("r"))
    each = mine.select("project_id", "batch_id", "received_at", "ordinal", F.posexplode("r.batch").alias("place", "e"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.col("e.type")), F.lit("invalid"))
    own = text.trimmed(F.get_json_object("e.body", "$.id"))
    return each.select(
        "project_id", "batch_id", "received_at", "ordinal", "place", F.col("e.id").alias("event_id"), F.col("e.timestamp").alias("sent_at"), F.col("e.type").alias("type"), kind.alias("kind"),
        F.coalesce(F.concat(F.lit("id:"), own), F.concat(F.lit("event:"), F.col("place"))).alias("key"), F.col("e.body").alias("body"),
    )


GROUP = ["project_id", "batch_id", "ordinal", "kind_group", "key"]


def _field(name: str) -> Column:
    """JSON text of a field of the parsed body; a sent null counts as not sent."""
    value = F.try_variant_get("_parsed", f"$.{name}", "variant")
    return F.when(~F.coalesce(F.is_variant_null(value), F.lit(True)), F.to_json(value))


def _merged(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per record and request: creates first, then updates, each field's last value."""
    named = [f"f_{f}" for f in (*fields, "id")]
    flat = rows.withColumn("_parsed", F.try_parse_json("body"))
    flat = flat.withColumns({f: _field(f.removeprefix("f_")) for f in named}).withColumn("_order", F.when(F.col("type").endswith("-update"), 1 << 32).otherwise(0) + F.col("place")).drop("_parsed")
    typed = F.when(~F.col("type").startswith("observation-"), F.col("kind"))
    flat = flat.withColumns({"kind_group": F.when(F.col("kind") == "trace", "trace").otherwise("observation"), "typed": typed})
    return flat.groupBy(*GROUP).agg(
        *last_sent(named, F.col("_order")), F.min_by(F.struct("kind", "type", "event_id", "sent_at", "body"), "place").alias("first"), F.max_by("sent_at", F.when(F.coalesce("sent_at", F.lit("")) != "", F.col("place"))).alias("last_sent"), F.max("received_at").alias("received_at"),
        F.max(F.col("typed").isNotNull()).alias("is_typed"), F.max("place").alias("place"), F.array_sort(F.collect_list("event_id")).alias("event_ids"),
    )


def _string(name: str) -> Column:
    """A field as text; empty text counts as not sent."""
    return F.nullif(F.try_variant_get(F.try_parse_json(f"f_{name}"), "$", "string"), F.lit(""))


def event_content(type_: Column, event_id: Column, sent_at: Column, body: Column) -> Column:
    """What an event without an id is known by: the canonical JSON list of its type, id, time and body."""
    head = F.to_json(F.array(type_, event_id, sent_at))
    return F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(","), F.coalesce(text.canonical_json(body), F.lit("null")), F.lit("]"))


def _record_id() -> Column:
    """The body's id, or one made from what the event holds."""
    content = event_content(F.col("first.type"), F.col("first.event_id"), F.col("first.sent_at"), F.col("first.body"))
    return F.coalesce(text.identifier(_string("id")), text.record_id(content))


_NO_MAP = "cast(map() as map<string,string>)"


def _sent(fields: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"f_{f}").isNotNull(), F.lit(c)) for f, c in fields.items()]))


def traces(rows: DataFrame) -> DataFrame:
    """Trace rows with ``provided``, the columns that were really sent."""
    m = _merged(rows.where("kind = 'trace'"), TRACE_FIELDS)
    names = dict(zip(TRACE_FIELDS, ("timestamp", "name", "user_id", "session_id", "environment", "release", "version", "tags", "metadata", "input", "output"), strict=True))
    return m.select(
        "project_id", "batch_id", "received_at", "ordinal", "place", _record_id().alias("id"), F.coalesce(F.try_to_timestamp(_string("timestamp")), F.try_to_timestamp("last_sent"), "received_at").alias("timestamp"),
        *[_string(f).alias(names[f]) for f in ("name", "userId", "sessionId")], text.environment(_string("environment")).alias("environment"), _string("release").alias("release"), _string("version").alias("version"),
        F.coalesce(F.from_json("f_tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), F.coalesce(text.json_map(F.col("f_metadata")), F.expr(_NO_MAP)).alias("metadata"),
        F.col("f_input").alias("input"), F.col("f_output").alias("output"), _sent(names).alias("provided"),
    )


def _observation_rows(rows: DataFrame) -> DataFrame:
    return _merged(rows.where(F.col("kind").isin("span", "generation", "event")), OBSERVATION_FIELDS)


def observations(rows: DataFrame) -> DataFrame:
    """Observation rows; those without a trace are errors."""
    m = _observation_rows(rows).where(_string("traceId").isNotNull())
    names = dict(zip(OBSERVATION_FIELDS, ("trace_id", "parent_observation_id", "name", "start_time", "end_time", "completion_start_time", "level", "status_message", "model", "model_parameters", "metadata", "input", "output", "usage_details", "usage_details", "cost_details"), strict=True))
    # numbers of a usage object; what isn't a number is dropped
    numbers = F.map_filter(F.transform_values(F.from_json(F.coalesce("f_usageDetails", "f_usage"), "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "double")), lambda _, v: v.isNotNull())
    provided = F.concat(F.array_distinct(_sent(names)), F.when(F.col("is_typed"), F.array(F.lit("type"))).otherwise(F.array().cast("array<string>")))
    return m.select(
        "project_id", "batch_id", "received_at", "ordinal", "place", _record_id().alias("id"), _string("traceId").alias("trace_id"), F.col("first.kind").alias("type"), _string("parentObservationId").alias("parent_observation_id"), _string("name").alias("name"),
        F.coalesce(F.try_to_timestamp(_string("startTime")), F.try_to_timestamp("last_sent"), "received_at").alias("start_time"), F.try_to_timestamp(_string("endTime")).alias("end_time"),
        F.try_to_timestamp(_string("completionStartTime")).alias("completion_start_time"), F.lower(F.coalesce(_string("level"), F.lit("default"))).alias("level"), _string("statusMessage").alias("status_message"), _string("model").alias("model"),
        text.json_map(F.col("f_modelParameters")).alias("model_parameters"), F.coalesce(text.json_map(F.col("f_metadata")), F.expr(_NO_MAP)).alias("metadata"), F.col("f_input").alias("input"), F.col("f_output").alias("output"),
        usage.counts(numbers).alias("usage_details"), F.from_json("f_costDetails", "map<string,decimal(18,9)>").alias("cost_details"), provided.alias("provided"),
    )


def scores(rows: DataFrame) -> DataFrame:
    """Scores with a value; numbers are numeric, anything else categorical."""
    value = F.try_variant_get(F.try_parse_json("body"), "$.value", "variant")
    get = lambda f: F.nullif(F.get_json_object("body", f"$.{f}"), F.lit(""))
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    content = event_content(F.col("type"), F.col("event_id"), F.col("sent_at"), F.col("body"))
    return rows.where("kind = 'score'").where(value.isNotNull() & ~F.is_variant_null(value) & get("traceId").isNotNull() & get("name").isNotNull()).select(
        "project_id", "batch_id", "received_at", "ordinal", "place", F.coalesce(get("id"), text.record_id(content)).alias("id"), get("traceId").alias("trace_id"), get("observationId").alias("observation_id"), get("name").alias("name"),
        F.when(numeric, "numeric").otherwise("categorical").alias("data_type"), F.when(numeric, F.try_variant_get(value, "$", "double")).alias("value"), F.when(~numeric, F.try_variant_get(value, "$", "string")).alias("string_value"),
        F.lit("api").alias("source"), get("comment").alias("comment"), F.col("received_at").alias("timestamp"),
    )


def responses(rows: DataFrame) -> DataFrame:
    """(project_id, batch_id, ordinal, event_id, status, message) of every event of a request."""
    no_trace = _observation_rows(rows).where(_string("traceId").isNull()).select("project_id", "batch_id", "ordinal", F.explode("event_ids").alias("event_id"), F.lit("missing required traceId").alias("lost"))
    good_scores = scores(rows).select("project_id", "batch_id", "ordinal", "place", F.lit(True).alias("fine"))
    joined = rows.join(no_trace, ["project_id", "batch_id", "ordinal", "event_id"], "left").join(good_scores, ["project_id", "batch_id", "ordinal", "place"], "left")
    message = F.when(F.col("kind") == "invalid", F.concat(F.lit("unsupported event type: "), "type")).when((F.col("kind") == "score") & F.col("fine").isNull(), "score requires a value, a name and a traceId").when(F.col("kind").isin("span", "generation", "event"), F.col("lost"))
    return joined.select("project_id", "batch_id", "ordinal", "event_id", F.when(message.isNull(), 201).otherwise(400).alias("status"), message.alias("message"))


def fold_requests(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of one record from several requests of a batch: later requests' sent fields win."""
    fields = [c for c in rows.columns if c not in (*key, "ordinal", "place", "provided", "received_at", "batch_id")]
    sent = rows.withColumns({f: F.when(F.array_contains("provided", f), F.col(f)) for f in fields})
    first = rows.groupBy(*key).agg(*[F.min_by(f, "ordinal").alias(f"_{f}") for f in fields], F.max("received_at").alias("received_at"), F.array_distinct(F.flatten(F.collect_list("provided"))).alias("provided"))
    later = fold_fields(sent, key, fields, ["ordinal"])
    return first.join(later, key).select(*key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields], "received_at", "provided")
