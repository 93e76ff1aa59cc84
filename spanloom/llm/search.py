"""Exact BM25 top-k by block-max WAND over shards of an inverted index.

Documents are dealt into shards of about ``SHARD_BYTES`` of text. A shard's index holds, for each term, the
postings (document, frequency), cut into blocks of ``BLOCK`` neighbouring documents, with the largest
impact of each block. Within a shard documents stand by their commonest term, then by length, so that
neighbours are alike and block maxima tight.

Queries go through a shard many at a time, those together whose best block is the same. A block is skipped, unread,
if for none of them its bound reaches the k-th best score: the sum of the block maxima of a query's common terms and the
shard's maxima of the others. In the blocks that are left common terms are scored by a matrix product in float32, others by their
postings; what comes within the rounding error of the k-th best score is scored again exactly.
Document frequencies, document count and mean length are those of the whole table, so that the
shards' lists merge exactly. Queries go out in blocks of at most ``QUERY_TERMS`` terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import durable, joined_bytes, pieces, received, ship, table
from spanloom.llm.suffix_dedup import BASES, Prefixes, mix

#: The parameters of BM25.
K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES, BLOCK = 16 << 20, 64
#: A term that stands in one document of SPARSE or more is common; of a shard's common terms so many at most, with so
#: many impacts in all, are held as a dense matrix (float32).
SPARSE, DENSE_TERMS, DENSE_CELLS = 32, 1500, 8 << 20
#: Relative error of a sum of DENSE_TERMS products in float32, bounded: (terms + 4) * 2^-24.
SLACK = 1e-4
#: Documents whose whole scores are added up at once.
EXACT = 256
#: Tasks of a search, as a multiple of the cluster's cores: a task goes through its shards one by one, and
#: the threshold that a query has reached in one holds in the next.
TASKS_PER_CORE = 2
#: Terms of the queries that are broadcast at once (16 bytes each).
QUERY_TERMS = 2_000_000
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all words of texts that lie in ``raw`` end to end; a term is a word's 64-bit hash."""
    inside = ~_SPACES[raw]
    edge = np.zeros(raw.size + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    text = np.searchsorted(bounds, begins, side="right") - 1
    return text, mix(Prefixes(raw, BASES[1]).of(begins, ends - begins) + (ends - begins).astype(np.uint64))


def term_counts(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, frequency), by term, then text; ``text`` must ascend."""
    by = np.argsort(term, kind="stable")
    term, text = term[by], text[by]
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])))) if term.size else np.zeros(0, np.int64)
    return term[first], text[first], np.diff(np.append(first, term.size))


def lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per shard; ``docs``: (doc_id, text in bytes). The columns hold packed arrays: ids and
    lengths of the documents, terms in order with their ends in the postings, and the postings."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    fields = "ids array<bigint>, lengths binary, terms binary, ends binary, docs binary, tfs binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def pack(parts: list[tuple[list, np.ndarray, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        term = np.concatenate([p[1] for p in parts])
        doc = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])
        tf = np.concatenate([p[3] for p in parts])
        n = len(ids)
        length = np.bincount(doc, weights=tf, minlength=n).astype(np.int64)
        common = np.zeros(n, np.uint64)
        top = np.lexsort((term, tf, doc))
        common[doc[top]] = term[top]  # the last one of a document stays: its most frequent term
        order = np.lexsort((np.arange(n), length, common))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        doc = place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        ends = np.flatnonzero(np.concatenate((term[1:] != term[:-1], [True]))) + 1 if term.size else np.zeros(0, np.int64)
        packed = (length[order].astype("<i4"), term[ends - 1].astype("<u8"), ends.astype("<i4"), doc.astype("<i4"), np.minimum(tf, 2**31 - 1).astype("<i4"))
        return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in pieces(batches, "text", 1 << 19):
            raw, bounds = joined_bytes(batch.column("text"))
            if parts and size + raw.size > 2 * shard_bytes:
                yield pack(parts)
                parts, size = [], 0
            parts.append((batch.column("doc_id").to_pylist(), *term_counts(*words_of(raw, bounds))))
            size += raw.size
        if parts:
            yield pack(parts)

    # dealt out in turn: shards are even whatever ids and texts repeat
    return durable(docs.repartition(shards).mapInArrow(run, fields))


def collection_statistics(index: DataFrame) -> tuple[int, float, DataFrame]:
    """Documents, their mean length, and (term, df) over all shards."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x, "<i4").astype(np.int64) for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.size for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], names=["docs", "words"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                t, df = np.frombuffer(terms, "<i8"), np.diff(np.frombuffer(ends, "<i4"), prepend=0).astype(np.int64)
                for at in range(0, t.size, 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(t[at : at + 50_000]), pa.array(df[at : at + 50_000])], names=["term", "df"])

    n, words = index.select("lengths").mapInArrow(sizes, "docs bigint, words bigint").agg(F.sum("docs"), F.sum("words")).first()
    df = index.select("terms", "ends").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return n or 0, (words or 0) / max(1, n or 0), df


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (doc_id, text in bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            term, text, tf = term_counts(*words_of(*joined_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(tf.astype(np.int64))], names=["query_id", "term", "qtf"])

    return queries.mapInArrow(run, "query_id bigint, term bigint, qtf bigint")


class ShardIndex:
    def __init__(self, batch: pa.RecordBatch, row: int, mean: float, block: int = BLOCK):
        packed = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: E731  no copy
        self.ids, self.terms, self.block = batch.column("ids")[row].as_py(), packed("terms", "<u8"), block
        self.docs, n = packed("docs", "<i4"), len(self.ids)
        tf, length = packed("tfs", "<i4").astype(np.float64), packed("lengths", "<i4").astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / max(mean, 1e-9)))[self.docs])
        self.last = packed("ends", "<i4").astype(np.int64)
        self.first = np.concatenate(([0], self.last))[:-1]
        df = self.last - self.first
        self.place = np.repeat(np.arange(df.size) * n, df) + self.docs  # a posting by term, then document: ascends
        self.most = np.maximum.reduceat(self.impact, self.first) if df.size else np.zeros(0)
        common = np.flatnonzero(df * SPARSE >= n)
        common = np.sort(common[np.argsort(-df[common], kind="stable")[: min(DENSE_TERMS, DENSE_CELLS // n)]])
        self.row = np.full(df.size, -1)  # of a common term in the dense impacts
        self.row[common] = np.arange(common.size)
        self.dense = np.zeros((common.size, n), np.float32)
        flat = ragged(self.first[common], self.last[common])
        self.dense[np.repeat(np.arange(common.size), df[common]), self.docs[flat]] = self.impact[flat]
        self.dense_most = np.maximum.reduceat(self.dense, np.arange(0, n, block), axis=1)

    def places(self, terms: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries whose terms lie end to end: the rows of the terms that the shard has, which of all the terms
        these are, and each query's bounds among them."""
        at = np.searchsorted(self.terms, terms)
        at[at == self.terms.size] = 0
        known = self.terms[at] == terms if self.terms.size else np.zeros(terms.size, bool)
        return at[known], np.flatnonzero(known), np.concatenate(([0], np.cumsum(known)))[bounds]

    def search(self, at: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int, best: list[list]) -> None:
        """Puts into ``best`` the k best of each query's list there and the shard, as (-score, id is null, id), in
        order; documents that share no term are none. Queries' terms, in the rows ``at``, lie end to end."""
        n, blocks = len(self.ids), self.dense_most.shape[1]
        some, each = max(1, min(2048, DENSE_CELLS // blocks)), max(1, min(128, DENSE_CELLS // 4 // n))
        for start in range(0, len(best), some):
            stop = min(start + some, len(best))
            inside = slice(bounds[start], bounds[stop])
            term, weight = at[inside], weights[inside]
            of, row = np.repeat(np.arange(stop - start), np.diff(bounds[start : stop + 1])), self.row[term]
            common = row >= 0
            asked = np.zeros((stop - start, self.dense.shape[0]), np.float32)
            asked[of[common], row[common]] = weight[common]
            rare = np.bincount(of[~common], weights=(weight * self.most[term])[~common], minlength=stop - start)
            bound = (asked @ self.dense_most) * (1 + SLACK) + rare[:, None]
            least = np.array([-best[q][k - 1][0] if len(best[q]) >= k else 0.0 for q in range(start, stop)])
            alive = (bound > 0) & (bound * (1 + SLACK) >= least[:, None])
            order = np.argsort(bound.argmax(axis=1), kind="stable")  # queries that look for the same blocks go together
            order = order[alive.any(axis=1)[order]]
            for i in range(0, order.size, each):
                group = order[i : i + each]
                open_ = np.repeat(alive[group].any(axis=0), self.block)[:n]
                docs = np.flatnonzero(open_)
                score = asked[group] @ (self.dense if docs.size == n else self.dense[:, docs])
                for q, dense in zip(group.tolist(), score, strict=True):
                    a, b = bounds[start + q], bounds[start + q + 1]
                    best[start + q] = self._best(at[a:b], weights[a:b], docs, dense, least[q], k, best[start + q])

    def _best(self, at: np.ndarray, weights: np.ndarray, docs: np.ndarray, dense: np.ndarray, least: float, k: int, best: list) -> list:
        """The k best of ``best`` and ``docs``, whose common terms' scores are known but for SLACK."""
        rare = self.row[at] < 0
        first, last = self.first[at[rare]], self.last[at[rare]]
        flat = ragged(first, last)
        near = dense + np.bincount(self.docs[flat], weights=np.repeat(weights[rare], last - first) * self.impact[flat], minlength=len(self.ids))[docs]
        hit = np.flatnonzero((near >= least * (1 - 2 * SLACK)) & (near > 0))
        if hit.size > k:
            hit = hit[near[hit] >= np.partition(near[hit], hit.size - k)[hit.size - k] * (1 - 3 * SLACK)]
        if not hit.size:
            return best
        docs = docs[hit]
        score = np.concatenate([self._exact(at, weights, docs[i : i + EXACT]) for i in range(0, docs.size, EXACT)])
        if docs.size > k:  # all that reach the k-th score
            reach = score >= np.partition(score, docs.size - k)[docs.size - k]
            docs, score = docs[reach], score[reach]
        return sorted(best + [(-s, self.ids[d] is None, self.ids[d] or 0) for d, s in zip(docs.tolist(), score.tolist(), strict=True)])[:k]

    def _exact(self, at: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whole scores, added up in the order of the query's terms: equal documents have equal ones in every shard."""
        wanted = (at[:, None] * len(self.ids) + docs).ravel()
        posting = np.minimum(np.searchsorted(self.place, wanted), self.place.size - 1)
        held = np.flatnonzero(self.place[posting] == wanted)
        return np.bincount(held % docs.size, weights=weights[held // docs.size] * self.impact[posting[held]], minlength=docs.size)


def ragged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1, ..."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, query_terms_: int = QUERY_TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (doc_id, text) by BM25 over all
    words, lower-cased, repeats in the query counted.

    Ties go to the smaller doc_id, a null one last. Null text counts as empty; it finds nothing and is
    never found, and documents without a common word aren't hits. Equal query rows are one query.
    Repeated documents are hits of their own. Other columns are ignored; empty tables give no rows.
    """
    index = build_index(lowered(docs), shard_bytes)
    n, mean, df = collection_statistics(index)
    asked = query_terms(lowered(queries).where("doc_id is not null").distinct())
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = durable(asked.join(df, "term").groupBy("query_id", "term", idf.alias("idf")).agg(F.sum("qtf").alias("qtf")))
    blocks = max(1, -(-asked.count() // query_terms_))
    out, tasks = None, max(1, TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")).toArrow()
        some = some.sort_by([("query_id", "ascending"), ("term", "ascending")])
        query, term, weight = (some.column(c).to_numpy() for c in ("query_id", "term", "weight"))
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if query.size else np.zeros(0, np.int64)
        shipped = ship(docs.sparkSession, (query[first], np.append(first, query.size), term.astype(np.int64).view(np.uint64), weight))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, bounds, terms, weights = received(shipped)
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = ShardIndex(batch, row, mean)
                    at, which, ends = shard.places(terms, bounds)
                    shard.search(at, weights[which], ends, k, best)
            found = [(q, None if none else d, -s) for q, some in zip(ids.tolist(), best, strict=True) for s, none, d in some]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

        part = durable(index.coalesce(tasks).mapInArrow(run, "query_id bigint, doc_id bigint, score double"))
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of the documents whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, docs.where("doc_id % 100 = 0"))
    return found.withColumn("score", F.round("score", 4))


OP2_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS n FROM tfs GROUP BY ALL),
whole AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM lengths) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY ALL),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * (d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / mean)))) AS score
  FROM tfs q JOIN tfs d USING (term) JOIN dfs USING (term) JOIN lengths l ON l.doc_id = d.doc_id, whole
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 10
"""
