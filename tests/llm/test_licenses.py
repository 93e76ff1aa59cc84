"""License scans against plain loops over words, and against SQL."""

import random
import re

import pytest

from spanloom.llm import licenses


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(licenses.WORDS, lowered)


def expected(texts):
    """(n_words, base starts, base labels, labels, score) of each text."""
    files = [words_of(t) for t in texts]
    vocabulary = {w for _, s, _ in licenses.TEMPLATES for w in s.split()}
    weight = {w: ((len(files) + 1) // (sum(w in f for f in files) + 1)).bit_length() for w in vocabulary}
    out = []
    for f in files:
        base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(f)) if f[i : i + len(p.split())] == p.split()]
        shares = []
        for label, sentence, key in licenses.TEMPLATES:
            s, k = sentence.split(), key.split()
            at = next(i for i in range(len(s)) if s[i : i + len(k)] == k)
            rare = sorted(enumerate(s), key=lambda x: (-weight[x[1]], x[0]))[: licenses.RARE]
            own = sorted({w for _, w in rare if w in f}, key=lambda w: (-weight[w], w))[: licenses.LOOKUPS]
            total = sum(weight[w] for _, w in rare)
            for start in {i - p for p, w in rare if w in own for i, x in enumerate(f) if x == w}:
                if start + at < 0 or f[start + at : start + at + len(k)] != k:
                    continue
                got = sum(weight[w] for p, w in rare if 0 <= start + p < len(f) and f[start + p] == w)
                if 100 * got >= licenses.AGREE * total:
                    shares.append((label, got / total))
        labels = {x for _, x in base} | {x for x, _ in shares}
        out.append((len(f), sorted(i for i, _ in base), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else max((x for _, x in shares), default=0.0)))
    return out


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, spots int, words string")
    rows = sorted(licenses.scan(docs).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return rows


def test_against_loops(spark):
    rng = random.Random(1)
    filler = "the a lorem ipsum general license by mit cc gnu apache public İ K x2 don't".split()
    texts = [None, "", "...", "MIT License", "mit-license mit license MIT\nLicense", "cc by by cc by", "GNU General  Public License gnu general public license", "K mit licenſe", "mitlicense é apache LICENSE", "license " * 5_000]
    for _, sentence, key in licenses.TEMPLATES:
        s = sentence.split()
        for changed in (0, 1, 4, 8):
            w = list(s)
            for _ in range(changed):
                w[rng.randrange(len(w))] = rng.choice(filler)
            texts.append(" ".join(rng.choices(filler, k=rng.randrange(20)) + w + rng.choices(filler, k=rng.randrange(5))).title())
        texts.append(" ".join(s[3:]))
        texts.append(key)
        texts.append(" ".join(s[: len(s) // 2] + ["inserted"] + s[len(s) // 2 :]))
    texts += [" ".join(rng.choices(filler, k=rng.randrange(300))) for _ in range(100)]
    for r, (n, starts, base, labels, score) in zip(found(spark, texts), expected(texts), strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None)), texts[r.doc_id]
        assert (r.base_labels, r.labels) == (base, labels), texts[r.doc_id]
        assert r.score == pytest.approx(score)


def test_labels_of_its_own_and_clean_texts(spark):
    rows = found(spark, [s for _, s, _ in licenses.TEMPLATES] + ["a poem about software that may be used by any person", "permission to enter is hereby granted to all"])
    for r, (label, _, _) in zip(rows, licenses.TEMPLATES):
        assert label in r.labels.split(",")
    assert [(r.labels, r.score) for r in rows[-2:]] == [("", 0.0)] * 2


def test_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, "cc by")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.labels, r.n_base) for r in licenses.scan(docs).collect()) == [(0, "cc-by", 1), (1, "mit", 1), (1, "mit", 1)]
    assert licenses.scan(docs.where("false")).count() == 0


def test_query_against_sql(same_rows):
    same_rows(licenses.op13_license_scan, licenses.OP13_SQL)


def test_sql_against_loops():
    import duckdb
    import pandas as pd

    texts = [s for _, s, _ in licenses.TEMPLATES] + ["x " + " ".join(s.split()[2:]) for _, s, _ in licenses.TEMPLATES] + [None, "", "mit license"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = con.sql(licenses.OP13_SQL + " ORDER BY doc_id").df()
    for r, (n, starts, base, labels, score) in zip(got.itertuples(), expected(texts), strict=True):
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (n, len(starts), base, labels)
        assert r.score == pytest.approx(score)
