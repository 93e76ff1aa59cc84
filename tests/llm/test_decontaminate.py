"""Benchmark decontamination against full alignments."""

import random

import numpy as np
import pytest

from spanloom.llm import decontaminate


def least_edits(item, text):
    """Of the whole item against any stretch of the text: a full matrix, row by row."""
    t = decontaminate.points(text)
    steps = np.arange(t.size + 1)
    row = np.zeros(t.size + 1, np.int64)
    for i, c in enumerate(decontaminate.points(item), 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (t != c))))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def wanted(item, text):
    item, text = decontaminate.normal(item), decontaminate.normal(text)
    if not item or not text:
        return None
    if len(item) < decontaminate.LEAST:
        return 0 if f" {item} " in f" {text} " else None
    e = least_edits(item, text)
    return e if e <= int(len(item) * decontaminate.BUDGET) else None


def test_query_against_full_alignment(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id): e for d in docs for i in items if (e := wanted(i.text, d.text)) is not None}
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.op10_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == want and want


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_edited_items(spark, most):
    rng = random.Random(5)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя"
    items = [(1, prose(latin, 20)), (2, prose(cyrillic, 20)), (3, prose(cyrillic, 150)), (4, "two words"), (5, "十二"), (6, None), (7, ""), (None, prose(latin, 9)), (8, "Two  WORDS")]
    texts = [None, "", "one two words more", "one two wordsmore", "zzz 十二", prose(latin, 60)]
    for _, item in items[:3]:
        n = len(item)
        for change in (0, 3, int(n * decontaminate.BUDGET), int(n * decontaminate.BUDGET) + 4, n // 3):
            x = list(item)
            for at in rng.sample(range(n), change):
                x[at] = rng.choice(["", "q" + x[at], "ж"])
            texts.append(prose(latin, 30) + " " + "".join(x).upper() + "  \n" + prose(cyrillic, 30))
    docs = spark.createDataFrame([(i, t, "x", i, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, start long, edits int, `end` int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark, most).collect()
    want = {(d, i): e for d, t in enumerate(texts) for i, item in items if i is not None and (e := wanted(item, t)) is not None}
    assert {(r.doc_id, r.item_id): r.edits for r in found} == want
    by_id = dict(items)
    for r in found:
        region = decontaminate.normal(texts[r.doc_id])[r.start : r.end]
        assert least_edits(decontaminate.normal(by_id[r.item_id]), region) == r.edits
    kept = decontaminate.clean(docs, benchmark, most)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "see this short item here"), (1, "see this short item here"), (None, "this short item")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, "this short item"), (5, "this short item"), (6, "this short item")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()) == [(0, 5), (0, 6), (1, 5), (1, 5), (1, 6), (1, 6)]
    assert decontaminate.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.where("false")).count() == 3 and decontaminate.clean(docs, benchmark).count() == 0


def test_repetitive_and_very_long_text():
    items = decontaminate.Items([(1, "ab" * 100), (2, "ab" * 30 + "c" + "ab" * 30), (3, "word " * 9 + "end")])
    assert [m[:2] for m in decontaminate.matches("ab" * 100_000, items)] == [(1, 0), (2, 1)]
    rng = random.Random(6)
    text = decontaminate.normal("".join(rng.choice("abcdefgh  ") for _ in range(1_500_000)) + " word" * 9 + " end" + "x y" * 9)
    (found,) = decontaminate.matches(text, items)
    assert found[:2] == (3, 0) and text[found[2] : found[3]] == "word " * 9 + "end"
