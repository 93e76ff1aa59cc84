"""Quality classifier: interpolated modified Kneser-Ney perplexity against trusted text.

The model counts byte n-grams up to ``ORDER`` over every trusted document, one model for each
language. Bytes keep the table small beside the corpus, so that counts are summed within a task before
they are shuffled, and an n-gram fits one 64-bit integer exactly: no hashing, no collisions.

The distinct n-grams of the documents to be scored meet the counts by plain joins, a length at a time from
single bytes up: on the n-gram, on its context and on its tail. Each key has 256 rows at most, so
Spark's hash shards are even however large a language is. The answers are joined to the documents'
n-grams. While they are few (``BROADCAST_GRAMS``, checked by counting them first) each task gets all of
them and no text is shuffled; beyond that documents send their n-grams to the answers' shards. Both
ways add up the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spanloom.llm.common import durable, forget, joined_bytes, pieces, table, unused

ORDER = 5
#: A language's limit is this quantile of the log perplexity of its held-back trusted documents: one trusted
#: text in FOLDS is held back from the counts, so the limit isn't drawn from text that the model has seen.
QUANTILE, FOLDS = 0.98, 5
#: Means over few bytes scatter: a document's threshold is the limit and SHORT / sqrt(bytes).
SHORT = 3.0
#: Answers that are broadcast at most (12 bytes each), and labels (8 bytes each).
BROADCAST_GRAMS, BROADCAST_LABELS = 3_000_000, 4_000_000
#: Log perplexities are ranked in steps of this size, so that quantiles need one short table.
STEP = 0.002
#: Bytes of text whose n-grams are counted at once.
COUNT_BYTES = 1 << 19


def grams(raw: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the n-gram that ends in it, as an integer of ``order`` bytes; each text begins
    with ``order - 1`` zero bytes of context."""
    padded = np.zeros(raw.size + order - 1, np.uint64)
    padded[order - 1 :] = raw
    out = np.zeros(raw.size, np.uint64)
    place = np.arange(raw.size) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(order):
        column = padded[order - 1 - back : order - 1 - back + raw.size] << np.uint64(8 * back)
        if back:
            column = np.where(place >= back, column, np.uint64(0))
        out |= column
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts; ``docs``: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]).astype(float)).astype(np.int64)

        def rows(lang: str, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, keys.size, 50_000):
                k = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k.size, pa.string()), pa.array(k.view(np.int64)), pa.array(n[i : i + 50_000])], names=["lang", "gram", "n"])

        for batch in pieces(batches, "text", COUNT_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                part = batch.filter(pa.array(langs == lang))
                found = np.unique(grams(*joined_bytes(part.column("text"))), return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append(found)
                if len(parts) >= 8:
                    held[lang] = [merged(parts)]
                    if held[lang][0][0].size > 1_000_000:  # a table of rare n-grams goes out in parts
                        yield from rows(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield from rows(lang, *merged(parts))

    some = docs.select(F.col("lang"), F.col("text").cast("binary").alias("text"))
    return some.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _low(gram: str, n: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def levels(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(lang, gram, c) of the n-grams of 1 to ``order`` bytes: how often the longest stand in the text, and
    after how many different bytes the shorter ones do."""
    out = [durable(counts.select("lang", "gram", F.col("n").alias("c")))]
    for n in range(order - 1, 0, -1):
        out.append(durable(out[-1].groupBy("lang", _low("gram", n).alias("gram")).agg(F.count("*").alias("c"))))
    return out[::-1]


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): Chen and Goodman's discounts of counts of 1, 2, and 3 or more; fixed ones where
    counts of counts are too few to tell. A row a language."""
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    enough = F.least(n1, n2, n3, n4) > 0
    told = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    some = [F.when(enough, F.when((t > 0) & (t < k), t)) for k, t in zip((1, 2, 3), told, strict=True)]
    sizes = level.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    return sizes.select("lang", *[F.coalesce(t, F.lit(d)).alias(f"d{k}") for k, t, d in zip((1, 2, 3), some, (0.5, 0.75, 0.9), strict=True)])


def answers(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) for the asked (lang, gram) of languages that have trusted text: log probabilities of
    the last byte after the others, in the precision of 32 bits. Each length is written before the next asks
    for it: five short plans instead of one long one, which the driver would hold and plan again whole."""
    tables = levels(counts, order)
    cut = durable(reduce(DataFrame.unionByName, [discounts(t).withColumn("n", F.lit(n)) for n, t in enumerate(tables, 1)]))
    asked = durable(asked.join(tables[0].select("lang").distinct(), "lang", "left_semi"))
    p = None
    for n in range(1, order + 1):
        own = cut.where(F.col("n") == n).drop("n")
        discount = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d1"))
        cutted = tables[n - 1].join(F.broadcast(own), "lang").select("lang", "gram", F.col("c"), discount.alias("d"))
        contexts = cutted.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        wanted = (asked if n == order else asked.select("lang", _low("gram", n).alias("gram")).distinct()).withColumns({"context": F.shiftright("gram", 8), "tail": _low("gram", n - 1)})
        if p is None:
            wanted = wanted.withColumn("lower", F.lit(1 / 256))
        else:
            wanted = wanted.join(p, ["lang", "tail"])
        wanted = wanted.join(contexts, ["lang", "context"], "left").join(cutted.select("lang", "gram", (F.col("c") - F.col("d")).alias("seen")), ["lang", "gram"], "left")
        told = (F.coalesce("seen", F.lit(0.0)) + F.col("left") * F.col("lower")) / F.col("total")
        found, before = wanted.select("lang", F.col("gram").alias("tail"), F.coalesce(told, "lower").alias("lower")), p
        p = durable(found) if n < order else found
        if before is not None and n < order:
            forget(before)
    return p.select("lang", F.col("tail").alias("gram"), F.log("lower").cast("float").alias("logp"))


def _per_document(raw: np.ndarray, bounds: np.ndarray, keys: np.ndarray, logp: np.ndarray) -> np.ndarray:
    found = grams(raw, bounds)
    at = np.minimum(np.searchsorted(keys, found), keys.size - 1)
    total = np.concatenate(([0.0], np.cumsum(logp[at], dtype=np.float64)))
    size = np.diff(bounds)
    return np.where(size > 0, -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1), np.nan)


def small(table_: DataFrame) -> Broadcast | None:
    """The answers by language for every task, if there are few; else None."""
    if table_.count() > BROADCAST_GRAMS:
        return None
    rows = table_.select("lang", "gram", "logp").toArrow()
    model = {}
    for name in rows.column("lang").unique().to_pylist():
        own = rows.filter(pa.compute.equal(rows.column("lang"), name)).sort_by("gram")
        model[name] = tuple(own.column(c).to_numpy() for c in ("gram", "logp"))
    return table_.sparkSession.sparkContext.broadcast(model)


def scored(docs: DataFrame, table_: DataFrame, shipped: Broadcast | None, lang: str = "model_lang", out: str = "log_ppl") -> DataFrame:
    """``docs`` with ``out``, the mean negative log probability of a byte; null where the text is empty or
    its language has no model. ``shipped`` is ``small(table_)``. Needs ``lang`` without nulls; ``out`` must be
    no column yet."""
    if shipped is not None:
        at = docs.columns.index(lang)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                langs = np.array(batch.column(at).to_pylist(), dtype=object)
                told = np.full(batch.num_rows, np.nan)
                for name in set(langs) & set(shipped.value):
                    pick = np.flatnonzero(langs == name)
                    keys, logp = shipped.value[name]
                    told[pick] = _per_document(*joined_bytes(batch.column("text").take(pa.array(pick)).cast(pa.binary())), keys.view(np.uint64), logp)
                yield batch.append_column(out, pa.array(told, pa.float64(), mask=np.isnan(told)))

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, n = np.unique(grams(*joined_bytes(batch.column(2).slice(i, 1))), return_counts=True)
                for at in range(0, found.size, 50_000):
                    k = found[at : at + 50_000]
                    columns = [pa.repeat(batch.column(0)[i], k.size), pa.repeat(batch.column(1)[i], k.size), pa.array(k.view(np.int64)), pa.array(n[at : at + 50_000])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "gram", "n"])

    key, hidden = F.sha2(F.concat_ws("\x00", lang, F.coalesce("text", F.lit(""))), 256), unused("key", docs)
    sent = docs.select(key.alias("key"), F.col(lang).alias("lang"), F.col("text").cast("binary").alias("text")).dropDuplicates(["key"])
    sent = sent.mapInArrow(own, "key string, lang string, gram bigint, n bigint")
    sums = sent.join(table_, ["lang", "gram"]).groupBy("key").agg((-F.sum(F.col("n") * F.col("logp").cast("double")) / F.sum("n")).alias(out))
    return docs.withColumn(hidden, key).join(sums.withColumnRenamed("key", hidden), hidden, "left").drop(hidden)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that some label calls good and none calls bad or toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def verdicts(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with some more columns, whose names clash with none, and what they say: log_ppl, threshold and
    keep, see ``judged``."""
    lang, ppl, limit = (unused(c, docs) for c in ("model_lang", "log_ppl", "limit"))
    docs = docs.withColumn(lang, F.coalesce("lang", F.lit("")))
    ids = durable(trusted_ids(labels))
    if ids.count() <= BROADCAST_LABELS:
        ids = F.broadcast(ids)
    trusted = docs.select("doc_id", F.col(lang).alias("model_lang"), "text").join(ids, "doc_id", "left_semi")
    trusted = trusted.withColumn("held_back", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)
    counts = durable(gram_counts(trusted.where("not held_back").select(F.col("model_lang").alias("lang"), "text")))
    asked = gram_counts(docs.select(F.col(lang).alias("lang"), "text")).select("lang", "gram")
    table_ = durable(answers(counts, asked))
    shipped = small(table_)
    short = SHORT / F.sqrt(F.greatest(F.octet_length("text"), F.lit(1)))
    bins = scored(trusted.select("model_lang", "held_back", "text"), table_, shipped).where("log_ppl is not null")
    bins = durable(bins.groupBy("model_lang", "held_back", F.ceil(F.col("log_ppl") / STEP).alias("bin")).agg(F.count("*").alias("n")))
    upto = W.partitionBy("model_lang").orderBy("bin")
    whole = W.partitionBy("model_lang")
    bins = bins.withColumn("any", F.max("held_back").over(whole)).where("held_back = any")  # all, where none is held back
    ranked = bins.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(whole))
    limits = ranked.groupBy(F.col("model_lang").alias(lang)).agg((F.min(F.when(F.col("share") >= quantile, F.col("bin"))) * STEP).alias(limit))
    out = scored(docs, table_, shipped, lang, ppl).join(durable(limits), lang, "left")
    threshold = F.col(limit) + short
    keep = (F.coalesce(F.octet_length("text"), F.lit(0)) > 0) & F.coalesce(F.col(ppl) <= threshold, F.lit(True))
    return out, F.col(ppl), threshold, keep


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` with log_ppl, threshold and keep; own columns of these names give way.

    A document is kept up to its language's threshold: the ``quantile`` of trusted documents, which
    rises a little for short texts. A language without trusted text has no threshold and keeps
    everything; null lang is a language of its own. Null and empty texts are not kept. Repeated
    rows are judged alike, and ties with the threshold are kept. Other columns pass through. An empty
    table gives none.
    """
    out, ppl, threshold, keep = verdicts(docs, labels, quantile)
    columns = [F.col(c) for c in docs.columns if c.lower() not in ("log_ppl", "threshold", "keep")]
    return out.select(*columns, ppl.alias("log_ppl"), threshold.alias("threshold"), keep.alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their own columns and no others."""
    out, _, _, keep = verdicts(docs, labels, quantile)
    return out.where(keep).select(*docs.columns)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = judged(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.round(F.exp("log_ppl"), 6).alias("perplexity"), F.round(F.exp("threshold"), 6).alias("threshold"), "keep")
