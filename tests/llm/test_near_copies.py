"""The pipeline's near copies against all pairs."""

import random

import numpy as np
import pytest

from spanloom.llm import components, simhash


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def one_each(texts, words=5, least=0.8):
    """Places of the first text of each group, by the similarity of all pairs."""
    sets = [shingles(t, words) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and (not a and not b or len(a & b) >= least * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.drop_near_copies(docs).collect()}


def test_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = one_each([t for _, t in rows])
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {rows[i][0] for i in kept}


def edited(rng, words, kind, share):
    """A copy with about ``share`` of its shingles changed."""
    w, n = list(words), len(words)
    if kind == "appended":
        return w + [rng.choice(words) for _ in range(int(n * share))]
    if kind == "cut off":
        return w[: int(n * (1 - share))]
    if kind == "moved":
        k = int(n * share / 2)
        at = rng.randrange(n - 2 * k)
        return w[:at] + w[at + k : at + 2 * k] + w[at : at + k] + w[at + 2 * k :]
    for _ in range(max(1, int(n * share / 10))):
        at = rng.randrange(len(w))
        if kind == "substituted":
            w[at] = f"new{rng.randrange(10**6)}"
        elif kind == "inserted":
            w.insert(at, f"new{rng.randrange(10**6)}")
        else:
            del w[at]
    return w


@pytest.mark.parametrize("few", [8, 48, 3])
def test_every_kind_of_edit(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for kind in ("substituted", "inserted", "deleted", "appended", "cut off", "moved"):
        for size in (30, 200, 1500):
            base = [rng.choice(vocabulary) for _ in range(size)]
            texts += [" ".join(base)] + [" ".join(edited(rng, base, kind, rng.choice([0.05, 0.15, 0.2, 0.3]))) for _ in range(5)]
    passage = [rng.choice(vocabulary) for _ in range(150)]  # many texts of one passage, some of them copies
    for _ in range(60):
        own = passage + [rng.choice(vocabulary) for _ in range(80)]
        texts += [" ".join(own), " ".join(edited(rng, own, "substituted", 0.1))]
    rng.shuffle(texts)
    assert left(spark, texts) == one_each(texts)


def test_rows(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (20, 150, 280)]
    clean = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(5)]
    texts = [" ".join(base), *near, " ".join(base), *clean, None, "", " ".join(sorted(base)), "a " * 300_000, "a " * 300_001]
    rows = [(10 + i, t, 0, 0, {"x": 1}) for i, t in enumerate(texts)] + [(10, " ".join(base), 0, 0, {"x": 1}), (None, " ".join(base), 0, 0, None), (None, clean[0] + " more", 1, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int, twin int, extra map<string,int>")
    kept = simhash.drop_near_copies(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [10, 15, 16, 17, 18, 19, 20, 22, 23]
    assert simhash.drop_near_copies(docs.where("false")).count() == 0


def test_sketches_lose_no_pair_and_leave_few_others():
    rnd = np.random.default_rng(3)
    sets, base = [], rnd.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)
    for _ in range(120):
        kept = base[rnd.random(base.size) > rnd.uniform(0, 0.2)]
        sets.append(np.unique(np.concatenate((kept, rnd.integers(0, 2**63, rnd.integers(0, 30)).astype(np.uint64)))))
    size, sketch = np.array([s.size for s in sets]), np.frombuffer(b"".join(map(simhash.sketch_of, sets)), np.uint64).reshape(len(sets), -1)
    left = far = 0
    for x in range(len(sets)):
        other = np.delete(np.arange(len(sets)), x)
        near = simhash._near(size, sketch, x, other, 0.8)
        like = np.array([simhash.alike(sets[x].tobytes(), sets[o].tobytes()) >= 0.8 for o in other])
        assert near[like].all()
        left, far = left + np.count_nonzero(near & ~like), far + np.count_nonzero(~like)
    assert left < far / 3


def test_sets_are_made_for_possible_pairs_and_rows_move_once(spark, monkeypatch):
    rng = random.Random(5)
    passage = [rng.choice("abcdefgh") * 3 + str(i) for i in range(30)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(100))]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string")
    rows = docs.selectExpr("unhex(md5(text)) AS key", "doc_id AS first", "text")
    rows = rows.unionByName(rows.where("first = 0"))  # an equal row gives no second link
    nodes = simhash.prefixes(rows, 5, 0.8)
    pairs = nodes.select("node").withColumnRenamed("node", "u").crossJoin(nodes.selectExpr("node AS v")).where("u < v")
    made, plain = [], simhash.shingle_sets
    monkeypatch.setattr(simhash, "shingle_sets", lambda t, words: made.append(t.count()) or plain(t, words))
    found = simhash.verified(pairs, nodes, rows, 5, 0.8).collect()
    ends = {r.node for r in nodes.where("first IN (0, 20)").collect()}
    assert [{r.u, r.v} for r in found] == [ends] and made == [3]
    plan = simhash.drop_near_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(mark") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize(("chunk", "most"), [(1 << 18, 0), (7, 9)])
def test_links_are_contracted_before_rounds(spark, monkeypatch, chunk, most):
    """A round is many jobs, whose plans the driver holds: one task's links take none."""
    rng = random.Random(8)
    pairs = [(10 * i, 10 * i + rng.randrange(1, 10)) for i in range(200)] + [(5000 + i, 5001 + i) for i in range(90)] + [(9000, 9001 + i) for i in range(90)]
    pairs = [rng.choice([p, p[::-1]]) for p in pairs]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "u long, v long")
    rounds, plain = [], components._small_star
    monkeypatch.setattr(components, "CHUNK", chunk)
    monkeypatch.setattr(components, "_small_star", lambda x: rounds.append(1) or plain(x))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(chunk, 10_000))
    try:
        got = {r.node: r.root for r in components.components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {max(p): 10 * (min(p) // 10) for p in pairs if max(p) < 5000}
    assert got == wanted | {5001 + i: 5000 for i in range(90)} | {9001 + i: 9000 for i in range(90)}
    assert len(rounds) <= most and bool(rounds) == bool(most)


def test_documents_are_broadcast_by_one_long(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")], "doc_id long, text string")
    plan = simhash.drop_near_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "HashedRelationBroadcastMode(List(input[0, bigint" in plan
