"""Search, repeated strings, near copies, mixing, quality, contamination and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import components, mixing, search, simhash, suffix_dedup
from spanloom.llm import entry as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_matches_sql(name, same_rows):
    same_rows(llm.QUERIES[name], llm.ORACLE[name])


def brute_removed(texts, least=200):
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = True
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return out


@pytest.mark.parametrize("crowd", [512, 2])
def test_repeated_strings(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8)).decode()
    passage, other = word(330), "é" * 150
    texts = [word(40) + passage + word(60) for _ in range(9)] + [word(30) + passage[i:] + word(500) for i in (50, 90, 131, 140)]
    texts += [other + word(5), word(900) + other, "ab" * 400, word(199), "", None, texts[0], texts[0], word(300) * 2, passage[:200] + "Z" + passage[100:300]]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id or 0: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, (kept, spans) in enumerate(brute_removed(raw)):
        assert (bytes(got[i].kept), len(got[i].removed) // 2, got[i].n_bytes) == (kept, spans, len(raw[i])), i
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 123, 5000).astype(np.uint8)).decode()
    docs = spark.createDataFrame([(1, text), (2, text[1200:2300] + "x"), (3, "y" + text[650:900])], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == [k for k, _ in brute_removed([r.text.encode() for r in docs.collect()])]


def test_repeated_strings_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in docs), brute_removed([(r.text or "").encode() for r in docs]), strict=True))
    for r in suffix_dedup.op6_suffix_dedup(spark, sf_dir).collect():
        kept, spans = want[r.doc_id]
        assert (r.n_spans, r.n_removed, r.kept_sha256) == (spans, r.n_bytes - len(kept), hashlib.sha256(kept).hexdigest())


def test_search_shards_merge_exactly(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0")
    one = search.search(docs, asked).collect()
    many = search.search(docs, asked, shard_bytes=40_000, query_terms_=150).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in one) == sorted((r.query_id, r.rank, r.doc_id) for r in many)


def test_search_odd_rows(spark):
    docs = spark.createDataFrame([(5, "a b c", 1), (3, "a b c", 2), (None, "a b c", 3), (4, None, 4), (6, "", 5), (7, "a " * 5000, 6), (8, "z", 7)], "doc_id long, text string, score int")
    got = [(r.query_id, r.doc_id) for r in search.search(docs, docs.where("doc_id in (3, 4, 6)"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(3, 3), (3, 5), (3, None)]
    assert search.search(docs.where("false"), docs.where("false")).count() == 0


def brute_fingerprint(text, words=4):
    import xxhash

    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not parts:
        return 0
    made = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fp = {r.doc_id: brute_fingerprint(r.text or "") for r in docs}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(5)
    fps, at = [], int(rng.integers(0, 1 << 62))
    for _ in range(200):  # a long chain of neighbours
        fps.append(at)
        for b in rng.choice(63, 4, replace=False):
            at ^= 1 << int(b)
    nodes = spark.createDataFrame([(f, f) for f in sorted(set(fps))], "fp long, node long")
    roots = components.components(simhash.links(nodes, 4))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(set(fps)) - 1


def test_components_against_union_find(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    root = {x: x for p in pairs for x in p if x is not None}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(links.where("false")).count() == 0


def test_mix_meets_targets(spark, sf_dir):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    slots = mixing.schedule(mixing.source_targets(spark.createDataFrame([("a", 300_000), ("b", 100_000), (None, 200_000)], "source string, size long"))).orderBy("slot").limit(100).collect()
    assert max(Counter(r["no"] for r in slots).values()) < 75  # every stretch holds the sources in proportion


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, None, "x"), (3, " ", "x"), (4, "c " * 5000, "y")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and {r["size"] for r in got if r.source == "x"} == {0}
    assert mixing.mix(docs.where("false")).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("doc_id in (2, 3)")).collect()} == {0}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert out.columns[: len(columns)] == columns and 0 < out.count()
    assert out.select("doc_id").distinct().count() == out.count() and out.where(F.col("taken") <= 0).count() == 0
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_search_scores_few_postings_one_by_one(spark, sf_dir, monkeypatch):
    """Common terms go by matrix products; what is found is that of all scores, and blocks are skipped."""
    docs = search.lowered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index = search.build_index(docs.where("doc_id is not null")).toArrow().combine_chunks().to_batches()[0]
    shard, k = search.ShardIndex(index, 0, 300.0, block=8), 10
    n, rng = len(shard.ids), random.Random(3)
    asked = []
    for d in rng.sample(range(n), 40):
        at = np.flatnonzero(np.bincount(np.repeat(np.arange(shard.terms.size), shard.last - shard.first)[shard.docs == d], minlength=shard.terms.size))
        asked.append((at, np.array([rng.uniform(0.001, 8) for _ in at])))
    want, whole = [], 0
    for at, weight in asked:
        score = np.zeros(n)
        for t, w in zip(at, weight, strict=True):
            score[shard.docs[shard.first[t] : shard.last[t]]] += w * shard.impact[shard.first[t] : shard.last[t]]
            whole += shard.last[t] - shard.first[t]
        want.append(sorted((-s, False, i) for s, i in zip(score.tolist(), shard.ids, strict=True) if s > 0)[:k])
    seen, plain = [], search.ragged
    monkeypatch.setattr(search, "ragged", lambda a, b: seen.append((b - a).sum()) or plain(a, b))
    best = [[] for _ in asked]
    bounds = np.cumsum([0] + [at.size for at, _ in asked])
    shard.search(np.concatenate([at for at, _ in asked]), np.concatenate([w for _, w in asked]), bounds, k, best)
    assert best == want and sum(seen) < whole / 2
    again = [list(b) for b in best]
    none = search.build_index(docs.limit(2).withColumn("text", docs.text.substr(1, 0))).toArrow().combine_chunks().to_batches()[0]
    empty = search.ShardIndex(none, 0, 300.0)
    empty.search(np.zeros(0, np.int64), np.zeros(0), np.zeros(41, np.int64), k, best)
    assert best == again
