"""Personal data by weak supervision.

Base spans come from fixed patterns. Wider patterns propose candidates; labelers of three sorts (patterns
and checksums, gazetteers, context) vote on each: +1 personal, -1 not, 0 no opinion. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is and gives every
pattern a probability; a logistic regression over votes, shape and context, trained on a bounded sample
with those probabilities as soft labels, decides each candidate. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import durable, table

#: Base kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Candidates that the span classifier is fitted on at most, the buckets of its features, the least
#: probability of an added span, and rounds of both trainings.
SAMPLE, FEATURES, SURE, EM_ROUNDS, FIT_ROUNDS = 4096, 512, 0.5, 60, 300

_LOCAL_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Goes from sign to sign, so that long runs of word characters cost nothing."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_END:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_DIGIT = re.compile(r"[0-9]")
#: Lists that the labelers look things up in.
NEAR = frozenset(
    "phone tel telephone mobile cell call fax whatsapp email e-mail mail contact reach write card visa mastercard amex credit debit iban"
    " account ssn passport telefon handy anruf karte konto kreditkarte teléfono móvil correo tarjeta cuenta téléphone courriel carte compte"
    " token key secret password passwd pwd apikey api_key api-key bearer".split()
)
AGAINST = frozenset("version page isbn issn order invoice item figure table section chapter line lines total price usd eur seite página année jahr año".split())
ENDINGS = frozenset("com net org edu gov info io de fr es eu uk co us ch at it nl be".split())
TITLES = frozenset("mr mrs ms dr prof herr frau señor señora sr sra monsieur madame mme".split())

_SPELLED = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|\bat\b)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s?[A-Za-z]{2,20})+(?!\w)", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
_NUMBER = re.compile(r"(?<![\w.,$€£+-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,6}(?:[ .-][0-9]{2,6}){0,2}(?![\w,%]|[.-][0-9])")
_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|token|secret|passw(?:or)?d|pwd)\b\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=.~-]{12,}+)[\"']?")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame|Mme)\.?\s([A-ZÀ-Ý][\w'-]{1,30}(?:\s[A-ZÀ-Ý][\w'-]{1,30})?)")
_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")


def spelled_addresses(text: str) -> list[tuple[str, int, int]]:
    """Addresses with "at" and "dot" in words. The sign is looked for first and the name read leftwards from it: a run
    of names without a sign costs nothing, and no name is read twice, as what follows its sign ends before the next."""
    out, done = [], 0
    for m in _SPELLED.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start == done or not (text[start - 1].isalnum() or text[start - 1] == "_"):
            while start < m.start() and text[start] in "._+-":  # names begin with a letter or a digit
                start += 1
            if start < m.start() and not (start and text[start - 1] in "._"):
                out.append(("email", start, m.end()))
                done = m.end()
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if "dot" in low:
        out += spelled_addresses(text)
    if _DIGIT.search(text):
        out += [("phone", m.start(), m.end()) for m in _NUMBER.finditer(text)]
    if any(x in low for x in ("token", "secret", "key", "passw", "pwd")):
        out += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    if any(x in text for x in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Monsieur", "Madame", "Mme")):
        out += [("name", m.start(1), m.end(1)) for m in _NAME.finditer(text)]
    return out


LABELERS = ("base pattern", "shape", "checksum", "near word", "word against", "ending", "variety", "surroundings")


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    span = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-4:]
    digits = [c for c in span if c.isdigit()]
    shape = {
        "email": bool(re.fullmatch(r"[\w.+-]+\s?(?:@|[([{]at[)\]}]|at)\s?\S+(?:\s\S+)*", span, re.I)),
        "phone": 9 <= len(digits) <= 15,
        "secret": len(span) >= 20 and any(c.isdigit() for c in span) and any(c.isalpha() for c in span),
        "name": " " in span,
    }.get(kind, True)
    checksum = 0
    if kind == "card" or 13 <= len(digits) <= 19:
        checksum = 1 if luhn("".join(digits)) else -1
    ending = 0
    if kind == "email":
        ending = 1 if span.rsplit(None, 1)[-1].rsplit(".", 1)[-1].lower().strip("()[]{}") in ENDINGS else -1
    variety = 0
    if digits:
        variety = 1 if len(set(digits)) >= 4 else -1
    around = (text[start - 1 : start] or " ") + (text[end : end + 1] or " ")
    return (
        int(base), 1 if shape else -1, checksum, 1 if NEAR.intersection(before) or (kind == "name" and TITLES.intersection(before)) else 0,
        -1 if AGAINST.intersection(before[-2:]) else 0, ending, variety, -1 if any(c.isalnum() for c in around) else 1,
    )


def features(text: str, kind: str, start: int, end: int, voted: tuple[int, ...]) -> list[int]:
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text[start : min(end, start + 64)])))
    words = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-2:]
    names = [f"k={kind}", f"s={kind}:{shape[:24]}", *(f"w={w}" for w in words), *(f"v{i}={v}" for i, v in enumerate(voted)), *(f"kv{kind}{i}={v}" for i, v in enumerate(voted))]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, tuple, list]]]:
    """Base spans, and every candidate (base spans included, marked by the first vote)."""
    base = base_spans(text)
    out = [(*s, v := votes(text, *s, True), features(text, *s, v)) for s in base]
    taken = sorted((a, b) for _, a, b in base)
    for s in proposals(text):
        if not any(a < s[2] and s[1] < b for a, b in taken):
            v = votes(text, *s, False)
            out.append((*s, v, features(text, *s, v)))
    return base, out


def reliabilities(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Dawid and Skene for two classes over vote patterns and their counts: the probability of
    personal data for each pattern. Labelers start better than chance, so the classes can't swap."""
    keys = sorted(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], float)
    v = np.array(keys)
    hot = np.stack([v == -1, v == 0, v == 1], axis=2).astype(float)  # pattern, labeler, vote
    p = 1 / (1 + np.exp(-v.sum(axis=1)))
    for _ in range(EM_ROUNDS):
        prior = (n @ p + 1) / (n.sum() + 2)
        theta = []
        for q in (p, 1 - p):
            mass = np.einsum("i,ijk->jk", n * q, hot) + 0.5
            theta.append(np.log(mass / mass.sum(axis=1, keepdims=True)))
        score = np.log(prior) - np.log(1 - prior) + np.einsum("ijk,jk->i", hot, theta[0] - theta[1])
        told = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        p = np.where(v[:, 0] == 1, np.maximum(told, 0.99), told)  # base spans are personal data by definition
    return dict(zip(keys, p.tolist(), strict=True))


def fit(rows: list[tuple[list[int], float]]) -> np.ndarray:
    x = np.zeros((len(rows), FEATURES + 1))
    x[:, -1] = 1
    for i, (f, _) in enumerate(rows):
        x[i, f] = 1
    y = np.array([p for _, p in rows])
    w = np.zeros(FEATURES + 1)
    for _ in range(FIT_ROUNDS):
        w += 0.5 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) / max(1, len(y)) - 1e-4 * w)
    return w


def text_spans(found: list[tuple[str, int, int, tuple, list]], weights: np.ndarray | None) -> list[tuple[str, int, int]]:
    """Base spans and the candidates that the classifier takes, by kind and start."""
    out = []
    for kind, start, end, voted, f in found:
        if voted[0] == 1 or (weights is not None and weights[f].sum() + weights[-1] >= np.log(SURE / (1 - SURE))):
            out.append((kind, start, end))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (rank.get(s[0], len(KINDS)), s[0], s[1], s[2]))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): a row per document; ``found`` is the JSON list of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(1).to_pylist():
                b, f = candidates(text or "")
                base.append(_joined(b))
                found.append(json.dumps(f) if f else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(found, pa.string())], names=["doc_id", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, base string, found string")


def learn(scanned: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The span classifier's weights. Vote patterns are counted over all candidates; the fit takes a
    sample of at most ``sample`` of them, spread over the patterns by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c for f in batch.column(0).to_pylist() for c in json.loads(f)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(c[3]) for c in rows], pa.string()), pa.array([json.dumps(c[4]) for c in rows], pa.string())], names=["votes", "features"])

    rows = scanned.where("found is not null").select("found").mapInArrow(run, "votes string, features string")
    kinds = durable(rows.groupBy("votes", "features").agg(F.count("*").alias("n")))
    found = kinds.groupBy("votes").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect()  # 3 ** labelers at most
    patterns = {tuple(json.loads(r.votes)): r.n for r in found}
    if not patterns:
        return None
    told = reliabilities(patterns)
    each = max(1, sample // len(patterns))
    sizes = kinds.sparkSession.createDataFrame([(r.votes, r.m) for r in found], "votes string, m bigint")
    place = F.pmod(F.xxhash64("features"), F.lit(1 << 40))
    near = kinds.join(F.broadcast(sizes), "votes").where(place * F.col("m").cast("double") < float((4 * each + 64) << 40))
    order = W.partitionBy("votes").orderBy(place, "features")
    some = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each)
    some = some.select("votes", "features").collect()
    return fit(sorted((json.loads(r.features), told[tuple(json.loads(r.votes))]) for r in some))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of each document, as ``kind:start:end`` lists.

    Null text counts as empty and has none. Repeated rows each get their row; a null doc_id stays null.
    Other columns are ignored; an empty table gives no rows. Texts are read once and whole.
    """
    scanned = durable(scan(docs))
    weights = learn(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_joined(text_spans(json.loads(f), weights)) if f else "" for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.string())], names=["doc_id", "base", "spans"])

    return scanned.mapInArrow(run, "doc_id bigint, base string, spans string")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span of ``column`` replaced by its kind in brackets; null text stays null."""
    weights = learn(durable(scan(docs.select("doc_id", F.col(column).alias("text")))))
    at = docs.columns.index(column)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for kind, start, end in sorted(text_spans(candidates(text)[1], weights), key=lambda s: (s[1], -s[2])):
            if start >= done:
                out += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2("base", 256).alias("base_sha256"), "spans")
