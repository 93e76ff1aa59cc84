"""Records that come again on another day, and rows merged field by field."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.time import sort_day

RECORD_KEY = ["kind", "project_id", "trace_id", "id"]


def last_of_batch(rows: DataFrame) -> DataFrame:
    """Each record's last row; ``ordinal`` numbers the batch's rows."""
    order = W.partitionBy(*RECORD_KEY).orderBy(F.desc("ordinal"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resolve(rows: DataFrame, stored: DataFrame, received_at: datetime | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to write, stored rows to delete) for a batch of whole-row upserts.

    ``rows`` and ``stored`` have the record key and sort_time; ``stored`` also event_ts. A record with a newer
    stored row isn't written, and its older rows go. Otherwise the stored rows of other days go. Without
    ``received_at`` each row brings its own event_ts, and the rows to delete have it as ``_at``."""
    mine = last_of_batch(rows)
    at = F.col("event_ts") if received_at is None else received_at if isinstance(received_at, Column) else F.lit(received_at)
    met = stored.join(mine.select(*RECORD_KEY, F.col("sort_time").alias("_new"), at.cast("timestamp").alias("_at")), RECORD_KEY)
    newer = met.where("event_ts > _at").select(*RECORD_KEY).distinct()
    written = mine.join(newer, RECORD_KEY, "left_anti")
    joined = met.join(newer.withColumn("_newer", F.lit(True)), RECORD_KEY, "left")
    other_day = (sort_day(F.col("sort_time")) != sort_day(F.col("_new"))) & (F.col("event_ts") <= F.col("_at"))
    gone = joined.where(F.when(F.col("_newer"), F.col("event_ts") < F.col("_at")).otherwise(F.coalesce(other_day, F.lit(False)))).drop("_new", "_newer")
    return written, gone if received_at is None else gone.drop("_at")


def fold_fields(rows: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """One row per key: each field's last value that isn't null, by ``order``. A null never erases."""
    return rows.groupBy(*key).agg(*last_sent(fields, F.struct(*order)))


def last_sent(fields: list[str], at: Column) -> list[Column]:
    """Aggregates: each field's last value that isn't null, by ``at``."""
    return [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]


def by_recency(incoming: DataFrame, stored: DataFrame, key: list[str], fields: list[str], received_at: Column, times: Column | None = None) -> DataFrame:
    """Field by field, what was received later wins, equal times going to the incoming row.

    ``incoming`` has ``provided`` (names of the fields that were really sent); ``times`` says when each was received
    where rows of several batches were folded, else all were at ``received_at``. ``stored`` has event_ts and
    ``sent_at`` (field to time; null for rows from before times were kept, which then count as sent at
    event_ts where they hold anything). Returns the key, the fields, ``sent_at`` and ``from_incoming``."""
    old = stored.select(*key, F.struct(*fields).alias("_old"), F.col("sent_at").alias("_sent"), F.col("event_ts").alias("_version"))
    joined = incoming.join(old, key, "left")
    out, sent, taken = {}, [], []
    for f in fields:
        mine = F.array_contains("provided", f)
        came = received_at if times is None else F.coalesce(F.try_element_at(times, F.lit(f)), received_at)
        held = F.col("_old")[f]
        implicit = F.when(holds(held, dict(stored.dtypes)[f]), F.col("_version"))
        again = F.when(mine, came)
        at = F.when(F.col("_sent").isNotNull(), F.try_element_at("_sent", F.lit(f))).when(F.col("_version") == received_at, again).otherwise(implicit)
        new = F.col("_version").isNull() | (mine & (at.isNull() | (came >= at)))
        keep = F.coalesce(~new & (at.isNotNull() | held.isNotNull()), F.lit(False))
        out[f] = F.when(keep, held).otherwise(F.col(f))
        sent.append(F.struct(F.lit(f).alias("key"), F.when(mine & new, came).otherwise(at).alias("value")))
        taken.append(F.when(~keep, F.lit(f)))
    kept = F.map_from_entries(F.filter(F.array(*sent), lambda e: e["value"].isNotNull()))
    return joined.select(*key, *[v.alias(k) for k, v in out.items()], kept.alias("sent_at"), F.array_compact(F.array(*taken)).alias("from_incoming"), F.col("_old").alias("stored"))


def holds(value: Column, kind: str) -> Column:
    """Not null, and not an empty list or map."""
    return value.isNotNull() & (F.size(value) > 0) if kind.startswith(("array", "map")) else value.isNotNull()


def consistent_cost(merged: DataFrame) -> DataFrame:
    """Keeps a derived cost in step with the usage and model it came from; a client's cost is never dropped.

    ``merged`` is what ``by_recency`` gives for observations, with ``provided`` joined on."""
    from spanloom.functions.pricing import PROVENANCE

    taken = lambda f: F.array_contains("from_incoming", f)
    plain = F.map_filter("metadata", lambda k, _: ~k.isin(*PROVENANCE))
    own_cost = taken("cost_details") & F.array_contains("provided", "cost_details")
    derived = F.col("stored").isNotNull() & F.col("stored.cost_details").isNotNull() & F.map_contains_key("stored.metadata", PROVENANCE[0]) & ~taken("cost_details")
    stale = F.coalesce(derived & ~own_cost & (taken("usage_details") | taken("model")), F.lit(False))
    keep = F.coalesce(derived & ~own_cost & ~stale & taken("metadata"), F.lit(False))
    held = F.map_filter("stored.metadata", lambda k, _: k.isin(*PROVENANCE))
    others = F.map_filter("metadata", lambda k, _: ~F.map_contains_key(held, k))
    client = F.coalesce(own_cost & F.col("stored").isNotNull() & ~taken("metadata"), F.lit(False))
    return merged.withColumns({
        "metadata": F.when(stale | client, plain).when(keep, F.map_concat(others, held)).otherwise(F.col("metadata")),
        "cost_details": F.when(~stale, F.col("cost_details")),
        "sent_at": F.when(stale, F.map_filter("sent_at", lambda k, _: k != "cost_details")).otherwise(F.col("sent_at")),
    })
