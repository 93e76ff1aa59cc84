"""Kneser-Ney perplexity and its thresholds, against plain counts."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality


class Plain:
    """Interpolated modified Kneser-Ney over bytes, with dictionaries."""

    def __init__(self, texts):
        levels = {quality.ORDER: Counter()}
        for t in texts:
            b = b"\0" * (quality.ORDER - 1) + t
            levels[quality.ORDER].update(b[i : i + quality.ORDER] for i in range(len(t)))
        for n in range(quality.ORDER - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        self.levels, self.cut, self.total, self.left = levels, {}, Counter(), defaultdict(float)
        for n, level in levels.items():
            n1, n2, n3, n4 = (sum(c == k for c in level.values()) for k in (1, 2, 3, 4))
            d = [0.5, 0.75, 0.9]
            if min(n1, n2, n3, n4):
                y = n1 / (n1 + 2 * n2)
                told = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
                d = [t if 0 < t < k else x for k, t, x in zip((1, 2, 3), told, d, strict=True)]
            self.cut[n] = [0.0, *d]
            for g, c in level.items():
                self.total[n, g[:-1]] += c
                self.left[n, g[:-1]] += self.cut[n][min(c, 3)]

    def p(self, g):
        if not g:
            return 1 / 256
        n, lower = len(g), self.p(g[1:])
        total = self.total.get((n, g[:-1]))
        if not total:
            return lower
        c = self.levels[n].get(g, 0)
        return (c - self.cut[n][min(c, 3)] + self.left[n, g[:-1]] * lower) / total

    def log_ppl(self, text):
        b = b"\0" * (quality.ORDER - 1) + text
        return -sum(math.log(self.p(b[i : i + quality.ORDER])) for i in range(len(text))) / len(text)


def plain_judged(docs, labels, held_back):
    """{doc_id: (log_ppl, threshold, keep)}; ``held_back`` holds the texts that aren't counted."""
    bad = {r.doc_id for r in labels if r.quality != 1 or (r.toxic or 0) != 0}
    good = {r.doc_id for r in labels} - bad
    out = {}
    for lang in {d.lang or "" for d in docs}:
        own = [d for d in docs if (d.lang or "") == lang]
        trusted = [d for d in own if d.doc_id in good and d.text]
        model = Plain([d.text.encode() for d in trusted if d.text not in held_back])
        known = bool(model.levels[1])
        score = {d.doc_id: model.log_ppl(d.text.encode()) if known else None for d in own if d.text}
        short = {d.doc_id: quality.SHORT / math.sqrt(len(d.text.encode())) for d in own if d.text}
        back = sorted(math.ceil(score[d.doc_id] / quality.STEP) for d in trusted if d.text in held_back or not any(t.text in held_back for t in trusted)) if known else []
        limit = back[math.ceil(quality.QUANTILE * len(back) - 1e-9) - 1] * quality.STEP if back else None
        for d in own:
            if not d.text:
                out[d.doc_id] = (None, None, False)
            else:
                threshold = None if limit is None else limit + short[d.doc_id]
                out[d.doc_id] = (score[d.doc_id], threshold, threshold is None or score[d.doc_id] is None or score[d.doc_id] <= threshold)
    return out


def test_query_against_plain_counts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = {r.text for r in docs.where(F.pmod(F.xxhash64("text"), F.lit(quality.FOLDS)) == 0).select("text").collect()}
    want = plain_judged(docs.collect(), labels.collect(), held)
    found = quality.op1_quality_classifier(spark, sf_dir).collect()
    assert len(found) == docs.count()
    for r in found:
        ppl, threshold, keep = want[r.doc_id]
        if ppl is None:
            assert r.perplexity is None
        else:
            assert r.perplexity == pytest.approx(math.exp(ppl), rel=1e-5)
        if threshold is not None:
            assert r.threshold == pytest.approx(math.exp(threshold), rel=1e-5)
        if ppl is None or threshold is None or abs(ppl - threshold) > 1e-5:
            assert r.keep == keep


def test_probabilities_add_up(spark):
    texts = ["abcabd abcab", "abcx abd", "bca bcd abc", "é"] * 3 + ["zzz", "abd zab"]
    counts = quality.gram_counts(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    context = int.from_bytes(b"abc ", "big") << 8
    asked = spark.createDataFrame([("en", context + x) for x in range(256)] + [("xx", 5)], "lang string, gram long")
    made = quality.answers(counts, asked).collect()
    assert len(made) == 256 and sum(math.exp(r.logp) for r in made) == pytest.approx(1, rel=1e-6)


def test_keeps_good_and_drops_junk(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs, labels).join(labels, "doc_id")
    good, bad = out.where("quality = 1 and toxic = 0"), out.where("quality = 0")
    assert good.where("keep").count() >= 0.97 * good.count()
    assert bad.where("not keep").count() >= 0.85 * bad.count()


def test_odd_rows_and_joined_scores(spark, monkeypatch):
    text = "the cat sat on the mat and the dog sat on the log " * 4
    rows = [(i, text + str(i), "en", 1) for i in range(12)] + [(50, None, "en", 2), (51, "", None, 3), (52, "qqqq zzzz", "xx", 4), (53, "#%&*!" * 50, "en", 5), (0, text + "0", "en", 6), (54, text * 3000, "en", 7), (None, text, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_back int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(0, None, None), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {(r.doc_id, r.held_back): r for r in quality.judged(docs, labels).collect()}
    kept = {k: r.keep for k, r in judged.items()}
    assert not kept[50, 2] and not kept[51, 3] and kept[52, 4] and not kept[53, 5] and kept[3, 1] and kept[54, 7] and kept[None, 8]
    assert judged[0, 1].log_ppl == judged[0, 6].log_ppl and judged[52, 4].threshold is None
    assert quality.judged(docs.where("false"), labels).count() == 0 and quality.judged(docs, labels.where("false")).where("keep").count() == len(rows) - 2
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 0)
    for r in quality.judged(docs, labels).collect():
        mine = judged[r.doc_id, r.held_back]
        assert (r.log_ppl is None, r.keep) == (mine.log_ppl is None, mine.keep)
        assert r.log_ppl is None or r.log_ppl == pytest.approx(mine.log_ppl, rel=1e-12)


def test_clashing_names(spark):
    text = "the cat sat on the mat and the dog sat on the log "
    names = "threshold log_ppl keep model_lang limit h key bin".split()
    rows = [(i, text + str(i), "en", *range(len(names))) for i in range(12)] + [(20, "", "en", *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, labels)
    assert sorted(out.columns) == sorted(docs.columns) and out.schema["log_ppl"].dataType.simpleString() == "double" and out.where("keep").count() == 12
    left = quality.kept(docs, labels)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == list(range(12)) and left.first()["keep"] == 2
