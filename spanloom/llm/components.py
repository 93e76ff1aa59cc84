"""Connected components of a link table, by alternating large and small stars.

Each task first turns its links into stars, CHUNK at a time, so that few links and often no rounds are left:
a round is many small jobs, whose plans are what the driver has to hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import durable, forget

#: Links that a task turns into stars at once; bounds its memory.
CHUNK = 1 << 18


def stars_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these links with the smallest one that it reaches over them; those themselves aren't listed."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(names.size)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]
    moved = root != np.arange(names.size)
    return names[moved], names[root[moved]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, stars by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (0, 1))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars_of(u, v)], names=["u", "v"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from out()
                rows = 0
        if rows:
            yield from out()

    return links.mapInArrow(run, "u bigint, v bigint")


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link and no end of one has a link itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(links.select("v", F.lit(0)).distinct())
    each = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return each.where("ups > 1 OR ups = 1 AND n > 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links``: two bigint columns. Returns (node, root): each linked node with the smallest
    node of its component; roots themselves are not listed. Rounds grow with the logarithm of
    the longest chain. Hot nodes are safe: minima are combined before the shuffle and the joins
    can be split. Null ends and self-links are left out; no links give no rows."""
    links = durable(_contracted(links.toDF("u", "v").where("u <> v").distinct()))
    for _ in range(most_rounds):
        if _settled(links):
            return links.toDF("node", "root")
        last, links = links, durable(_small_star(_large_star(links).where("u <> v").distinct()).where("u <> v").distinct())
        forget(last)
    raise RuntimeError(f"no end after {most_rounds} rounds")
