"""Hard negatives by exact search over one-dimensional distance keys.

Components become whole numbers, so scores are exact. With M the greatest length of a row, a row x is augmented by
sqrt(M^2 - |x|^2) and an anchor a by 0: then |a - x|^2 = |a|^2 + M^2 - 2 a.x, and the best scores are the nearest
rows. Every row belongs to its nearest pivot, and rows are stored sorted by (pivot, distance to it). By the triangle
inequality a row of key d lies at least |d - key of the anchor| away, so a search expands an interval of keys around
the anchor's key at every pivot: each step scans the new annulus only, and it ends when the scores that the next one
could hold can't reach the k-th found. Anchors search part by part of the stored rows; the parts' lists merge exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import durable, forget, received, shared_dir, ship, table

#: Fixed values of the query: positives and negatives a list, the least and greatest share of a positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SCALE = 256
#: Pivots are the first so many distinct rows by hash. Rows of a cell are scored together.
PIVOTS, CELL_ROWS, ANCHOR_ROWS = 64, 1024, 1024
#: Anchors whose vectors take so many bytes are broadcast at a time; bytes of vectors that one stored part holds.
WAVE_BYTES, PART_BYTES = 8 << 20, 32 << 20
#: The first radius is this share of M; it doubles with each annulus.
FIRST_RADIUS = 1 / 16
#: Rows of a squared length beyond this take no part: their scores have no long.
LONGEST = 2.0**62
NONE = -(2**63) + 1

FOUND = "anchor_no bigint, anchor_id bigint, vec_id bigint, score bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & whole)
    return found.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col(vector).cast("array<double>").alias("vector"))


def _matrix(lists: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The vectors as rows of whole numbers; shorter ones are filled up with zeros."""
    sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (16 << 20) // (8 * max(1, dims)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


@dataclass
class Space:
    """What all tasks know of the rows: the pivots (whole numbers) and the bounds of the vectors."""

    dims: int
    stored: str  # how components are kept
    scored: str  # in what sums of products are exact
    most: float  # M^2
    scale: int
    pivots: np.ndarray

    def rest(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - norms))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, distance to it) of augmented rows."""
        norms = (x * x).sum(axis=1)
        own = (self.pivots * self.pivots).sum(axis=1)
        products = x @ self.pivots.T + np.outer(self.rest(norms), self.rest(own))
        d = np.sqrt(np.maximum(0, 2 * self.most - 2 * products))
        nearest = d.argmin(axis=1)
        return nearest, d[np.arange(len(x)), nearest]

    def anchor_keys(self, a: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        norms = (a * a).sum(axis=1)
        return np.sqrt(np.maximum(0, (norms + self.most)[:, None] - 2 * (a @ self.pivots.T)))


def _space(rows: DataFrame, scale: int, pivots: int) -> Space | None:
    """A pass over all rows for their bounds, and the pivots. None if no row takes part."""
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, dims):
            x = _matrix(batch.column(0), dims, scale)
            norms = (x * x).sum(axis=1)
            fit = norms <= LONGEST
            if fit.any():
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(x[fit]).max(initial=0))]), pa.array([float(norms[fit].max())])], names=["component", "norm"])

    component, most = rows.select("vector").mapInArrow(run, "component double, norm double").agg(F.max("component"), F.max("norm")).first()
    if most is None:
        return None
    first = rows.orderBy(F.xxhash64("vector"), "vec_id").limit(pivots).select("vector").collect()
    x = np.unique(np.array([np.pad(np.floor(scale * np.array(r.vector, float)), (0, dims - len(r.vector))) for r in first]), axis=0)
    x = x[(x * x).sum(axis=1) <= most]
    scored = "float32" if most < 2**24 else "float64" if most < 2**53 else "int64"
    return Space(dims, "int16" if component < 2**15 else "int64", scored, most, scale, x if len(x) else np.zeros((1, dims)))


def stored_index(rows: DataFrame, space: Space) -> DataFrame:
    """(pivot, dist, vec_id, label, vector) in the shared folder, in parts sorted by (pivot, dist)."""
    spark = rows.sparkSession
    shipped = ship(spark, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shipped)
        for batch in _slices(batches, own.dims):
            x = _matrix(batch.column("vector"), own.dims, own.scale)
            fit = np.flatnonzero((x * x).sum(axis=1) <= LONGEST)
            x = x[fit]
            pivot, dist = own.keys(x)
            raw = np.ascontiguousarray(x.astype(own.stored)).view(np.uint8).reshape(len(x), -1)
            vectors = pa.array([r.tobytes() for r in raw], pa.binary())
            ids, labels = (batch.column(c).take(pa.array(fit)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(dist), ids, labels, vectors], names=["pivot", "dist", "vec_id", "label", "vector"])

    keyed = rows.mapInArrow(run, "pivot int, dist double, vec_id bigint, label bigint, vector binary")
    size = rows.count() * space.dims * np.dtype(space.stored).itemsize
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return durable(keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id"))


@dataclass
class Part:
    """Stored rows that one task searches, cut into cells: neighbours by key of one pivot."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    bounds: np.ndarray  # of the cells
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], space: Space) -> Part:
        got = pa.Table.from_batches(batches)
        pivot, dist, ids, labels = (got.column(c).to_numpy() for c in ("pivot", "dist", "vec_id", "label"))
        vectors = np.concatenate([np.frombuffer(b"".join(b.column("vector").to_pylist()), space.stored).reshape(b.num_rows, space.dims) for b in batches])
        runs = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(ids)]])
        bounds = np.unique(np.concatenate([np.arange(a, b, CELL_ROWS) for a, b in zip(runs, runs[1:])] + [runs]))
        first = bounds[:-1]
        return cls(ids, labels, vectors, bounds, pivot[first], np.minimum.reduceat(dist, first), np.maximum.reduceat(dist, first))


@dataclass
class Wave:
    """Anchors of one search. ``low`` and ``high`` bound the scores of each of an anchor's lists."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool  # look for rows of the anchor's label, or of others
    k: int


def _keep(scores: np.ndarray, places: np.ndarray, who: np.ndarray, s: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
    """Puts hits of lists ``who`` into the lists, best first, ties by id."""
    k = scores.shape[1]
    lists = np.unique(who)
    who, s, at = np.concatenate([who, np.repeat(lists, k)]), np.concatenate([s, scores[lists].ravel()]), np.concatenate([at, places[lists].ravel()])
    order = np.lexsort((ids[at], -s, who))
    who, s, at = who[order], s[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    best = (starts[:, None] + np.arange(k)).ravel()
    scores[lists], places[lists] = s[best].reshape(-1, k), at[best].reshape(-1, k)


def search(part: Part, wave: Wave, rows: slice, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places in the part) of the best k rows of every list of the anchors ``rows``, by expanding annuli."""
    vectors = wave.vectors[rows]
    exact = vectors.astype(float)
    n, lists, k = len(vectors), wave.low.shape[1], wave.k
    low, high = wave.low[rows], wave.high[rows]
    scores, places = np.full((n * lists, k), NONE, np.int64), np.zeros((n * lists, k), np.int64)
    whole = (exact * exact).sum(axis=1) + space.most
    keys = space.anchor_keys(exact)[:, part.pivot]
    slack = 1e-6 * (1 + np.sqrt(space.most))  # far above what rounding does to a key
    gap = np.maximum(0, np.maximum(part.low - keys, keys - part.high) - slack)
    nearest, farthest = (whole[:, None] - gap**2) / 2 + slack, (whole[:, None] - (keys + part.high + slack) ** 2) / 2 - slack
    inner, radius = -1.0, FIRST_RADIUS * np.sqrt(space.most)
    while True:
        need = np.maximum(low, scores[:, -1].reshape(n, lists))
        open_ = (low <= high) & ((whole[:, None] - max(0.0, inner) ** 2) / 2 + slack >= need)
        if not open_.any():
            return scores, places  # nothing beyond the last radius can reach a k-th score
        annulus = (gap > inner) & (gap <= radius)
        for cell in np.flatnonzero(annulus.any(axis=0)):
            need = np.maximum(low, scores[:, -1].reshape(n, lists))
            asked = open_ & (nearest[:, cell, None] >= need) & (farthest[:, cell, None] <= high)
            mine = np.flatnonzero(annulus[:, cell] & asked.any(axis=1))
            if not len(mine):
                continue
            a, b = part.bounds[cell], part.bounds[cell + 1]
            product = (vectors[mine] @ part.vectors[a:b].astype(space.scored).T).astype(np.int64)
            fits = (wave.labels[rows][mine, None] == part.labels[a:b]) == wave.same
            fits &= wave.ids[rows][mine, None] != part.ids[a:b]
            for i in range(lists):
                ok = fits & (product >= need[mine, i, None]) & (product <= high[mine, i, None])
                ok &= asked[mine, i, None]
                if b - a > k and ok.sum() > 64 * len(mine):
                    least = np.partition(np.where(ok, product, NONE), -k, axis=1)[:, -k]
                    ok &= product >= least[:, None]
                who, at = np.nonzero(ok)
                if len(who):
                    _keep(scores, places, mine[who] * lists + i, product[who, at], a + at, part.ids)
        if radius > 3 * np.sqrt(space.most):
            return scores, places
        inner, radius = radius, 2 * radius


def _searched(stored: DataFrame, wave: Wave, space: Space) -> DataFrame:
    """The wave's best rows of every part, as FOUND: a row of several lists comes once."""
    shipped = ship(stored.sparkSession, (wave, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        own, known = received(shipped)
        part = Part.of(got, known)
        for start in range(0, len(own.ids), ANCHOR_ROWS):
            rows = slice(start, start + ANCHOR_ROWS)
            scores, places = search(part, own, rows, known)
            lists = own.low.shape[1]
            hit = scores.ravel() > NONE
            who = np.repeat(np.arange(len(scores)) // lists, own.k)[hit] + start
            pairs, first = np.unique(np.stack([who, places.ravel()[hit]]), axis=1, return_index=True)
            columns = [pairs[0], own.ids[pairs[0]], part.ids[pairs[1]], scores.ravel()[hit][first]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_no", "anchor_id", "vec_id", "score"])

    return stored.mapInArrow(run, FOUND)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, pivots: int = PIVOTS, wave_bytes: int = WAVE_BYTES, vector: str = "embedding") -> DataFrame:
    """RESULT for the rows for which ``anchors`` (over vec_id and label) holds: for each of an anchor's ``positives``
    best other rows of its label, the ``negatives`` best rows of other labels whose score is ``low`` to ``high``
    hundredths of the positive's.

    Rows with a null vec_id or label, a null vector or a component that is null or not finite take no part. Vectors
    of several lengths are filled up with zeros. Ties go by smaller vec_id; rows with the anchor's vec_id aren't
    others. A repeated row can fill several places; repeated anchors count once, and rows that share an anchor's id
    but not its vector or label are anchors of their own. A positive without a fitting negative gives no row, and so
    does an empty table. Other columns aren't read. ``low`` and ``high`` are whole numbers.

    Anchors search in waves of ``wave_bytes`` of vectors, which are broadcast; the rows move once, when they are stored.
    """
    spark = rows.sparkSession
    known = usable(rows, vector)
    space = _space(known, scale, pivots)
    if space is None:
        return spark.createDataFrame([], RESULT)
    stored = stored_index(known, space)
    asked = durable(stored.where(anchors).select("vec_id", "label", "vector").distinct())
    per_wave = max(1, wave_bytes // max(1, space.dims * np.dtype(space.scored).itemsize))
    waves = max(1, -(-asked.count() // per_wave))
    # dealt round robin: a wave holds at most a row a task more than its share
    dealt = durable(asked.repartition(waves).withColumn("wave", F.spark_partition_id()))
    base = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for no in range(waves):
        got = dealt.where(F.col("wave") == no).drop("wave").toArrow()
        ids, labels = got.column("vec_id").to_numpy(), got.column("label").to_numpy()
        vectors = np.frombuffer(b"".join(got.column("vector").to_pylist()), space.stored).reshape(len(ids), space.dims).astype(space.scored)
        anywhere = np.full((len(ids), 1), NONE, np.int64), np.full((len(ids), 1), 2**63 - 1, np.int64)
        best = W.partitionBy("anchor_no").orderBy(F.desc("score"), "vec_id")
        near = _searched(stored, Wave(ids, labels, vectors, *anywhere, True, positives), space)
        near = durable(near.withColumn("no", F.row_number().over(best)).where(F.col("no") <= positives))
        lowest, highest = np.full((len(ids), positives), 1, np.int64), np.full((len(ids), positives), 0, np.int64)
        for r in near.toLocalIterator():  # positives of one wave
            lowest[r.anchor_no, r.no - 1], highest[r.anchor_no, r.no - 1] = -(-low * r.score // 100), high * r.score // 100
        far = _searched(stored, Wave(ids, labels, vectors, lowest, highest, False, negatives), space)
        pairs = near.select("anchor_no", "no", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        hits = far.select("anchor_no", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        fits = F.expr(f"{low} * cast(positive_score as decimal(20,0)) <= 100 * cast(negative_score as decimal(20,0)) and 100 * cast(negative_score as decimal(20,0)) <= {high} * cast(positive_score as decimal(20,0))")
        order = W.partitionBy("anchor_no", "no").orderBy(F.desc("negative_score"), "negative_id")
        ranked = pairs.join(hits, "anchor_no").where(fits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{base}/{no}")
        forget(near)
    forget(asked, dealt, stored)
    return spark.read.schema(RESULT).parquet(*[f"{base}/{no}" for no in range(waves)])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM whole a JOIN whole r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
