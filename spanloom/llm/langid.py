"""Language identification in two steps: family first, then one-versus-one linear SVMs within it.

Features are hashed counts of the letters' one- to three-grams over the whole text. Training rows are
a bounded sample (``SAMPLE_PER_LANG`` documents of each language, those with the smallest hash of
their text), so the driver only ever holds that many vectors; predictions cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import durable, table

#: Families of languages by their codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "es fr it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi bn ur pa mr gu ne si".split(),
    "sinitic": "zh yue".split(),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

BUCKETS = 1 << 12
#: Documents of a language that are learned from at most, and languages whose sizes are broadcast.
SAMPLE_PER_LANG, BROADCAST_LANGS = 300, 100_000
#: Characters of a training vector's text are all read; rounds and strength of the SVMs' training.
ROUNDS, LAMBDA = 12, 1e-4
STEP = 1 << 20


def vector(text: str) -> np.ndarray | None:
    """Square roots of hashed gram shares, of length one; None if there is no letter."""
    if not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(BUCKETS, np.float64)
    text = text.lower()
    for at in range(0, len(text), STEP):  # very long texts, two characters shared by neighbours
        points = np.frombuffer(text[at : at + STEP + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        small = points.astype(np.uint64)
        gram = np.zeros(small.size, np.uint64)
        for n in (1, 2, 3):
            m = small.size - n + 1
            if m <= 0:
                break
            gram = (gram[:m] * np.uint64(0x1F_FFFF_FFFF_3B)) + (small[n - 1 :] + np.uint64(n)) * np.uint64(0x9E37_79B9_7F4A_7C15)
            mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58_476D_1CE4_E5B9)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def train_svm(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Averaged Pegasos: weights and bias of a linear SVM for labels +1 and -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, rng, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.random.default_rng(seed), 0
    for _ in range(ROUNDS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            t += 1
            wrong = y[at] * (x[at] @ w) < 1
            push = (x[at] * (y[at] * share[at] * wrong)[:, None]).mean(axis=0)
            w = (1 - 1 / (t + 10)) * w + push / (LAMBDA * 1000 * (t + 10))
            mean += (w - mean) / t
    return mean


def fit(rows: list[tuple[str, np.ndarray]]) -> dict:
    """Family SVMs (one against the rest) and, within each family, one SVM for every two languages."""
    langs = sorted({lang for lang, _ in rows})
    family = {lang: FAMILY_OF.get(lang, f"own:{lang}") for lang in langs}
    x = np.stack([v for _, v in rows]) if rows else np.zeros((0, BUCKETS))
    of = np.array([lang for lang, _ in rows])
    families = sorted(set(family.values()))
    kin = np.array([family[lang] for lang in of])
    heads = {f: train_svm(x, np.where(kin == f, 1, -1)) for f in families} if len(families) > 1 else {}
    duels = {}
    for f in families:
        own = [lang for lang in langs if family[lang] == f]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                use = (of == a) | (of == b)
                duels[a, b] = train_svm(x[use], np.where(of[use] == a, 1, -1))
    return {"families": {f: [lang for lang in langs if family[lang] == f] for f in families}, "heads": heads, "duels": duels}


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -20, 20))))


def predict(model: dict, v: np.ndarray | None) -> tuple[str, float]:
    """The language and a score of 0 to 1: how sure the family is, times the votes' mean margin."""
    families = model["families"]
    if v is None or not families:
        return "und", 0.0
    v = np.append(v, 1.0)
    margins = {f: float(v @ w) for f, w in model["heads"].items()}
    best = max(margins, key=lambda f: (margins[f], f)) if margins else next(iter(families))
    score = _sure(margins[best]) if margins else 1.0
    own = families[best]
    if len(own) > 1:
        votes, sums = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for (a, b), w in model["duels"].items():
            if a in votes:
                m = float(v @ w)
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        lang = max(own, key=lambda x: (votes[x], sums[x], x))
        return lang, score * _sure(sums[lang] / (len(own) - 1))
    return own[0], score


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict:
    """``labelled``: (text, lang). The sample is taken before vectors are made, of distinct texts; the
    driver gets at most ``per_lang`` vectors a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, v in enumerate(made) if v is not None]
            vectors = pa.array([made[i].astype(np.float32).tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), vectors], names=["lang", "v"])

    keys = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # what can be among the smallest hashes, told from the number of distinct texts, so that other texts don't move
    place = F.pmod("h", F.lit(1 << 40))
    sizes = durable(keys.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    if sizes.count() <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    near = keys.join(sizes, "lang").where(place * F.col("n").cast("double") < float((4 * per_lang + 64) << 40))
    distinct = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    some = distinct.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(place, "h"))).where(F.col("r") <= per_lang)
    rows = some.select("lang", "text").mapInArrow(run, "lang string, v binary").collect()
    return fit(sorted(((r.lang, np.frombuffer(r.v, np.float32).astype(np.float64)) for r in rows), key=lambda r: (r[0], r[1].tobytes())))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    Null text and text without a letter are ``und`` with score 0, as is everything when the model has
    seen no language. Repeated rows each get their row; a null doc_id stays null. Only doc_id and text
    are read, whatever other columns are called.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors a pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [predict(shipped.value, vector(t) if t else None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
