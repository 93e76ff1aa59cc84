"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets are filled like water: the budget is shared by weight and no source passes ``most_passes``
times its size. Each source's documents are shuffled by a hash of their id and cut into blocks of
equally many words. Slots are the van der Corput points of base two: slot *i* is the point whose
binary digits are those of *i* mirrored, mapped through the sources' cumulative slot counts, so every
stretch of the schedule holds each source in proportion. A slot's rank within its source names the
block it takes, round after round. The words a document gives are the blocks' takes over its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import durable, table, word_count

#: The weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of all sources that the mix takes, and the most passes over one source.
SHARE, MOST_PASSES = 1.5, 2
BLOCK_WORDS = 1024
#: Documents that one bucket of the running total holds, about; slots ranked together.
BUCKET_ROWS, CHUNK_SLOTS = 4096, 1 << 16


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST_PASSES, block: int = BLOCK_WORDS) -> DataFrame:
    """A row per source: (source, no, weight, source_size, target, goal, blocks, slots, first_slot).
    One row a source crosses to a single task, after partial sums."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("no", F.row_number().over(order)).withColumn("weight", weights[(F.col("no") - 1) % len(WEIGHTS)])
    cap = F.col("source_size") * most
    filled = W.orderBy(cap / F.col("weight"), "no").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(filled), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    per = per.withColumn("level", left / weight_left)
    per = per.withColumn("level", F.max("level").over(everything))
    per = per.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level")))
    per = per.withColumn("goal", F.round("target").cast("long"))
    blocks = F.ceil(F.col("source_size") / block)
    last = F.col("goal") - 1
    slots = F.expr(f"(goal - 1) div source_size * ceil(source_size / {block}) + (goal - 1) % source_size div {block} + 1")
    per = per.withColumn("blocks", blocks).withColumn("slots", F.when(last >= 0, slots).otherwise(F.lit(0)).cast("long"))
    before = W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def mirrored(point: Column, digits: int) -> Column:
    """``point`` with its ``digits`` binary digits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(point), digits, "0")), 2, 10).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, no, rank): the slots in order of time are ``slot`` ascending; ``rank`` counts within a
    source from 0. Points meet their source by equality on a cell of the unit interval."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    digits = max(1, math.ceil(math.log2(max(2, total))))
    cell_bits = max(0, digits - 10)
    points = spark.range(0, total).select(F.col("id").alias("point"), F.shiftright("id", cell_bits).alias("cell"))
    end = F.col("first_slot") + F.col("slots")
    cells = F.sequence(F.shiftright("first_slot", cell_bits), F.shiftright(end - 1, cell_bits))
    held = sources.where("slots > 0").select("no", "first_slot", end.alias("end"), F.explode(cells).alias("cell"))
    slots = points.join(held, "cell").where("point >= first_slot and point < end")
    slots = slots.select(mirrored(F.col("point"), digits).alias("slot"), "no").withColumn("chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    counts = slots.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("no", "chunk").orderBy("slot"))
    return slots.withColumn("within", within).join(base, ["no", "chunk"]).select("slot", "no", (F.col("base") + F.col("within") - 1).alias("rank"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(no, doc_id, size, start): where each document's words begin in its source's shuffled stream.
    Running totals are taken within hash buckets and over the buckets, so no source is one task."""
    rows = sizes.count()
    digits = max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    docs = sizes.join(sources.select("source", "no"), sizes.source.eqNullSafe(sources.source)).drop("source")
    docs = docs.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("h", 1, digits))
    before = W.partitionBy("no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = docs.groupBy("no", "bucket").agg(F.sum("size").alias("n")).select("no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(base, ["no", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("h", "bucket", "base", "inside")


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST_PASSES, block: int = BLOCK_WORDS, carry: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, *carry) for every row of ``docs``.

    Null or empty text has size 0 and gives 0 words; a null source is a source of its own, last in
    order. Repeated rows are documents of their own; rows with equal ids are told apart by size, and
    beyond that are alike. A table with no words has targets of 0; an empty one gives no rows. Only
    doc_id, text and source are read. Reruns agree: the order is a hash of the id.
    """
    sizes = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry))
    sources = durable(source_targets(sizes, share, most, block))
    start = F.expr(f"rank div blocks * source_size + rank % blocks * {block}")
    length = F.least(F.lit(block), F.expr(f"source_size - rank % blocks * {block}"))
    takes = (
        schedule(sources).join(sources, "no").withColumn("length", length).withColumn("words", F.least("length", F.col("goal") - start))
        .groupBy("no", F.expr("rank % blocks").alias("block"))
        .agg(F.count_if(F.col("words") == F.col("length")).alias("whole"), F.coalesce(F.max(F.when(F.col("words") < F.col("length"), F.col("words"))), F.lit(0)).alias("part"))
    )
    at = placed(sizes, sources)
    spans = at.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    part_high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("part"))
    given = (high - low) * F.col("whole") + F.greatest(F.lit(0), part_high - low)
    taken = spans.join(takes, ["no", "block"], "left").groupBy("no", "start").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", *carry)], F.coalesce(F.sum(given), F.lit(0)).alias("taken")
    )
    empty = at.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.unionByName(empty).join(sources, "no").select("doc_id", "source", "size", "source_size", "target", "taken", *carry)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


#: The words a document gives are those of its source's shuffled stream that lie before the goal,
#: in the first pass or the second.
OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM per),
weighed AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(CAST(2 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
    coalesce(sum(s.size) OVER (PARTITION BY t.no ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(goal, start + size) - start) + greatest(0, least(goal, source_size + start + size) - source_size - start) AS BIGINT) AS taken
FROM placed
"""
