"""OTLP exports: every span is an observation; a trace's first root span is also the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import attributes as A
from spanloom.functions import text, usage
from spanloom.functions.time import from_unix_nano
from spanloom.schemas import OTLP_REQUEST
from spanloom.sources import messages

#: Attribute names, the preferred first.
MODEL = ("gen_ai.request.model", "gen_ai.response.model")
PROVIDER = ("gen_ai.provider.name", "gen_ai.system")
SESSION, USER, RELEASE = ("gen_ai.conversation.id", "session.id"), ("user.id",), ("service.version",)
ENVIRONMENT = ("deployment.environment.name", "deployment.environment")
OPERATION, COST = "gen_ai.operation.name", "gen_ai.usage.cost"
INPUT, OUTPUT = "gen_ai.input.messages", "gen_ai.output.messages"
COUNTS = {
    "input_tokens": ("gen_ai.usage.input_tokens",), "output_tokens": ("gen_ai.usage.output_tokens",), "cache_read_input_tokens": ("gen_ai.usage.cache_read.input_tokens",),
    "cache_creation_input_tokens": ("gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write.input_tokens"),
}
PARAMETERS = tuple(f"gen_ai.request.{n}" for n in ("temperature", "max_tokens", "top_p", "top_k", "frequency_penalty", "presence_penalty", "seed"))


def spans(events: DataFrame) -> DataFrame:
    """(project_id, batch_id, received_at, place, resource, span) of OTLP events; ``place`` keeps the order of
    the request."""
    mine = events.where("source = 'otlp'").select("project_id", "batch_id", "received_at", "ordinal", F.from_json("body", OTLP_REQUEST).alias("r"))
    resources = mine.select("*", F.posexplode("r.resourceSpans").alias("i", "rs"))
    scopes = resources.select("*", F.col("rs.resource.attributes").alias("resource"), F.posexplode("rs.scopeSpans").alias("j", "ss"))
    return scopes.select("project_id", "batch_id", "received_at", "ordinal", "i", "j", "resource", F.posexplode("ss.spans").alias("k", "span")).select(
        "project_id", "batch_id", "received_at", F.struct("ordinal", "i", "j", "k").alias("place"), F.coalesce("resource", F.expr("array()").cast(_ATTRIBUTES)).alias("resource"), "span"
    )


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>>>"


def _first(list_: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[A.string_of(list_, n) for n in names])


def _root() -> Column:
    return F.coalesce(F.col("span.parentSpanId"), F.lit("")) == ""


def traces(rows: DataFrame) -> DataFrame:
    """A trace per first root span, named and timed by it."""
    s, r = F.coalesce("span.attributes", F.expr("array()").cast(_ATTRIBUTES)), F.col("resource")
    order = W.partitionBy("project_id", "batch_id", F.col("span.traceId")).orderBy("place")
    first = rows.where(_root()).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select(
        "project_id", "batch_id", "received_at", F.col("span.traceId").alias("id"), from_unix_nano(F.col("span.startTimeUnixNano")).alias("timestamp"), F.col("span.name").alias("name"),
        A.first_string([r], list(USER)).alias("_u"), A.first_string([s, r], list(USER)).alias("user_id"), A.first_string([s, r], list(SESSION)).alias("session_id"), text.environment(_first(r, ENVIRONMENT)).alias("environment"),
        A.first_string([r], list(RELEASE)).alias("release"), F.array().cast("array<string>").alias("tags"), A.as_map(r).alias("metadata"),
    ).drop("_u")


def observations(rows: DataFrame) -> DataFrame:
    """An observation a span. ``rows`` are to hold whole exports, since messages are read within an export's budget."""
    rows = messages.with_messages(rows, F.coalesce("span.attributes", F.expr("array()").cast(_ATTRIBUTES)), (INPUT, OUTPUT), ["project_id", "batch_id", "place.ordinal"])
    s = F.coalesce("span.attributes", F.expr("array()").cast(_ATTRIBUTES))
    rows = rows.withColumns({"_by_key": A.firsts(s), "_own": A.as_map(s)})  # read once; all fields look up in these
    of = lambda n: F.try_element_at("_by_key", F.lit(n))
    text_of = lambda names: F.coalesce(*[of(n)["stringValue"] for n in names])
    rows = rows.withColumns({f"_{k}": F.coalesce(*[usage.token_count(A.number(of(n))) for n in names]) for k, names in COUNTS.items()} | {"_model": text_of(MODEL), "_provider": text_of(PROVIDER), "_cost": usage.cost_amount(A.number(of(COST)))})
    counts = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_{k}").alias("value")) for k in COUNTS])
    model, provider, cost, own = F.col("_model"), F.col("_provider"), F.col("_cost"), F.col("_own")
    metadata = F.when(provider != "", F.map_concat(F.map_filter(own, lambda k, _: k != PROVIDER[0]), F.create_map(F.lit(PROVIDER[0]), provider))).otherwise(own)
    operation = F.map_contains_key("_by_key", OPERATION)
    return rows.select(
        "project_id", "batch_id", "received_at", "place", F.col("span.spanId").alias("id"), F.col("span.traceId").alias("trace_id"), F.nullif("span.parentSpanId", F.lit("")).alias("parent_observation_id"),
        F.when(operation | model.isNotNull(), "generation").otherwise("span").alias("type"), F.col("span.name").alias("name"), from_unix_nano(F.col("span.startTimeUnixNano")).alias("start_time"),
        from_unix_nano(F.col("span.endTimeUnixNano")).alias("end_time"), F.when(F.col("span.status.code") == 2, "error").otherwise("default").alias("level"), F.nullif("span.status.message", F.lit("")).alias("status_message"),
        F.nullif(model, F.lit("")).alias("model"), A.model_parameters(s, PARAMETERS, "gen_ai.request.", lambda n: A.number(of(n))).alias("model_parameters"), A.present(counts).alias("usage_details"),
        F.when(cost.isNotNull(), F.create_map(F.lit("total"), cost)).alias("cost_details"), F.coalesce(metadata, own).alias("metadata"), F.col("input_messages").alias("input"), F.col("output_messages").alias("output"),
    )


def unmapped(rows: DataFrame) -> DataFrame:
    """Spans whose times aren't unsigned nanoseconds: they fail their export."""
    return rows.where(from_unix_nano(F.col("span.startTimeUnixNano")).isNull() | (F.col("span.endTimeUnixNano").isNotNull() & from_unix_nano(F.col("span.endTimeUnixNano")).isNull()))
