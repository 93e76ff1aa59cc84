"""Fill-in-the-middle against slices of Python strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import infill

LETTERS = "aé漢🙂<>PSM \n"


def array(text):
    return np.frombuffer(text.encode(), np.uint8)


@pytest.mark.parametrize("every, step", [(1, 7), (3, 4), (16, 64), (1024, 1 << 20)])
def test_places_against_encoded_prefixes(every, step):
    rng = random.Random(every)
    for n in (0, 1, 2, 3, 17, 500):
        text = "".join(rng.choice(LETTERS) for _ in range(n))
        count, numbers, places = infill.index(array(text), every, step)
        assert count == n
        assert [len(text[:i].encode()) for i in numbers] == places.tolist()
        assert [infill.byte_of(array(text), i, numbers, places, every) for i in range(n + 1)] == [len(text[:i].encode()) for i in range(n + 1)]


def expected(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rows_against_slices(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "<", "<P", "a<P>b", "<S>", "<<M>>", "x" * 3_000_000, "é漢🙂" * 400_000, "M>" * 50, "<" * 50]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, "twice", "x"), (7, "twice", "x"), (None, "no id at all", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumnRenamed("output", "form")
    made = infill.fill_in_middle(docs)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i is None, i or 0, *map(str, expected(i, t)), t or "") for i, t, _ in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.where("false")).count() == 0


def test_query_against_sql(same_rows):
    same_rows(infill.op12_fill_in_middle, infill.OP12_SQL)
