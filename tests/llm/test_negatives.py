"""Hard negatives against sorting all rows for every anchor."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import negatives

SHAPE = "vec_id long, label int, embedding array<float>, score string"


def expected(rows, is_anchor, k=5, scale=256):
    ok = [(i, y, [math.floor(scale * float(np.float32(c))) for c in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, ya, va in {(i, y, tuple(v)) for i, y, v in ok if is_anchor(i)}:
        told = sorted((-sum(p * q for p, q in zip(va, v)), i, y) for i, y, v in ok if i != a)
        for sp, p, yp in [t for t in told if t[2] == ya][:k]:
            fit = [t for t in told if t[2] != ya and 80 * -sp <= 100 * -t[0] <= 100 * -sp][:k]
            out += [(a, p, n, i, -sp, -s) for n, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, condition, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, condition, **options).collect())


@pytest.mark.parametrize("case", ["plain", "close", "copies", "lengths", "large"])
def test_rows_against_sorting(spark, case):
    rng = random.Random(case)
    size = 6 if case != "large" else 3
    spread = {"close": 0.02, "large": 3e4}.get(case, 1)
    centre = [rng.gauss(0, 1) for _ in range(size)]
    rows = []
    for i in range(600):
        v = [c + rng.gauss(0, spread) for c in centre]
        if case == "copies" and i % 3 == 0:
            v = centre
        if case == "lengths":
            v = v[: i % 7]
        rows.append((i, rng.randrange(4), v))
    if case == "copies":
        rows += rows[:60] + [(20, 9, centre), (None, 1, centre), (5, None, centre), (6, 1, None), (7, 1, [None] * size), (8, 1, [math.nan] * size), (9, 1, [math.inf] * size)]
    want = expected(rows, lambda i: i % 20 == 0)
    assert found(spark, rows, F.col("vec_id") % 20 == 0, pivots=7, wave_bytes=100) == want
    assert case == "lengths" or want


def test_searches_skip_cells_and_stay_exact(monkeypatch):
    """On clustered rows most cells are never scored."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 8)), 50, axis=0) + 0.01 * rng.normal(size=(2000, 8))))
    monkeypatch.setattr(negatives, "CELL_ROWS", 16)
    space = negatives.Space(8, "int16", "float32" if (x * x).sum(1).max() < 2**24 else "float64", float((x * x).sum(1).max()), 256, x[::50])
    pivot, dist = space.keys(x)
    order = np.lexsort((dist, pivot))
    at = np.flatnonzero(np.diff(pivot[order])) + 1
    bounds = np.unique(np.concatenate([[0, 2000], at, np.arange(0, 2000, 16)]))
    part = negatives.Part(order, np.zeros(2000, np.int64), x[order].astype("int16"), bounds, pivot[order][bounds[:-1]], np.minimum.reduceat(dist[order], bounds[:-1]), np.maximum.reduceat(dist[order], bounds[:-1]))
    scored = []
    keep = negatives._keep
    monkeypatch.setattr(negatives, "_keep", lambda *a: (scored.append(len(a[2])), keep(*a)))
    ids = np.arange(0, 2000, 100)
    wave = negatives.Wave(ids, np.zeros(20, np.int64), x[ids].astype(space.scored), np.full((20, 1), negatives.NONE), np.full((20, 1), 2**62), True, 5)
    scores, places = negatives.search(part, wave, slice(0, 20), space)
    for n, i in enumerate(ids):
        told = sorted((-int(x[i] @ x[j]), j) for j in range(2000) if j != i)[:5]
        assert [(-s, order[p]) for s, p in zip(scores[n], places[n])] == told
    assert sum(scored) < 20 * 2000 / 4


def test_empty_and_no_anchor(spark):
    assert found(spark, [], F.lit(True)) == []
    assert found(spark, [(1, 1, None)], F.lit(True)) == []
    assert found(spark, [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [1.0])], F.lit(False)) == []


def test_query_against_sql(same_rows):
    same_rows(negatives.op11_hard_negatives, negatives.OP11_SQL)
