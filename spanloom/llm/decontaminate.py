"""Benchmark decontamination by the q-gram lemma.

A text region within ``e`` edits of an item of ``n`` characters shares at least ``n - q + 1 - q * e``
q-grams with it, and all of these lie in diagonals no further apart than ``e``. So: texts are cut into
positions whose q-gram is one of the benchmark's, these hits are counted in overlapping diagonal bands
of twice the budget, and only bands that meet the bound are aligned, within the band, against the item.
Everything counts in characters (code points). Hits are counted in pieces, so that repetitive texts
take no more memory than others; bands of an item are aligned together.

A share of the items is broadcast at a time (``BROADCAST_CHARS`` at most, checked by summing): one share,
unless the benchmark is very large, and then one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import durable, received, ship, table

Q = 8
#: Edits allowed, as a share of an item's characters, rounded down; items of fewer than LEAST characters
#: are matched as whole words, with no edits (one edit would spoil most of their q-grams).
BUDGET, LEAST = 0.08, 24
BROADCAST_CHARS = 4_000_000
#: Hits that are counted at once, and cells of bands that are aligned at once.
HITS, CELLS = 1 << 20, 1 << 20
#: Characters of texts that are looked through together, about.
LINES = 1 << 16
_K = [np.uint64(x) for x in (0x9E37_79B9_7F4A_7C15, 0xC2B2_AE3D_27D4_EB4F, 0x1656_67B1_9E37_79F9)]


def normal(text: str | None) -> str:
    """Lower case, white space as one space."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram that begins at each character; two that collide only cost an alignment."""
    h, reach = chars.astype(np.uint64), 1
    for k in _K:
        if h.size <= reach:
            return np.zeros(0, np.uint64)
        h = h[:-reach] * k + h[reach:]
        h ^= h >> np.uint64(31)
        reach *= 2
    return h


def _slot(gram: np.ndarray) -> np.ndarray:
    return ((gram * _K[0]) >> np.uint64(42)).astype(np.int64)


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .. first[1] + n[1] - 1, ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Items:
    """Items with their sorted q-grams and the places where these stand; short items apart."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted({(i, t) for i, t in rows if t})
        self.short: dict[str, list[int]] = {}
        for item, text in rows:
            if len(text) < LEAST:
                self.short.setdefault(text, []).append(item)
        rows = [r for r in rows if len(r[1]) >= LEAST]
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        self.chars = [points(t) for t in self.texts]
        made = [grams(c) for c in self.chars]
        gram = np.concatenate([np.zeros(0, np.uint64), *made])
        order = np.argsort(gram, kind="stable")
        sizes = np.array([g.size for g in made], np.int64)
        self.owner = np.repeat(np.arange(sizes.size), sizes)[order]
        self.place = ragged(np.zeros(sizes.size, np.int64), sizes)[order]
        self.keys, self.first = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.first, gram.size))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_slot(self.keys)] = True
        self.length = np.array([c.size for c in self.chars], np.int64)
        self.edits = (self.length * BUDGET).astype(np.int64)
        self.bound = self.length - Q + 1 - Q * self.edits  # what the lemma asks: 9 at least, from LEAST on
        self.words: ahocorasick.Automaton | None = None

    def whole_words(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of short items that stand in the text between spaces or its ends."""
        if not self.short:
            return
        if self.words is None:
            self.words = ahocorasick.Automaton()
            for short, items in self.short.items():
                self.words.add_word(f" {short} ", (len(short), items))
            self.words.make_automaton()
        for last, (n, items) in self.words.iter(f" {text} "):
            for item in items:
                yield item, last - n - 1, last - 1

    def hits(self, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the text, item, place in the item) of all shared q-grams, in pieces."""
        at = np.flatnonzero(self.bits[_slot(gram)])
        where = np.searchsorted(self.keys, gram[at])
        ok = self.keys[np.minimum(where, self.keys.size - 1)] == gram[at] if self.keys.size else np.zeros(at.size, bool)
        at, where = at[ok], where[ok]
        piece = np.cumsum(self.count[where]) // HITS
        for cut in np.split(np.arange(at.size), np.flatnonzero(np.diff(piece)) + 1):
            n = self.count[where[cut]]
            flat = ragged(self.first[where[cut]], n)
            yield np.repeat(at[cut], n), self.owner[flat], self.place[flat]

    def bands(self, gram: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of a band) of the bands with as many hits as the lemma asks. A band is
        twice as wide as the budget and the next begins in its middle, so that every stretch of the
        budget's width lies in one. A diagonal is a position less a place."""
        parts = []
        for at, owner, place in self.hits(gram):
            half = (at - place + self.length[owner]) // (self.edits[owner] + 1)
            key = owner * (1 << 40) + half
            parts.append(np.unique(np.concatenate([key, key - 1]), return_counts=True))  # band b: halves b and b + 1
        if not parts:
            return []
        key, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([c for _, c in parts]))
        owner, half = (key + 1) >> 40, ((key + 1) & ((1 << 40) - 1)) - 1
        ok = n >= self.bound[owner]
        return [(i, h * (int(self.edits[i]) + 1) - int(self.length[i])) for i, h in zip(owner[ok].tolist(), half[ok].tolist(), strict=True)]


def banded(item: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, anchored: bool = False) -> np.ndarray:
    """Least edits between the whole ``item`` and a stretch of ``text`` that ends on each of ``width`` diagonals
    from each of ``first`` on: a row per band. With ``anchored`` the stretch begins at the text's start."""
    offsets = np.arange(width)
    far = item.size + text.size + width  # no place in the text: costs more than any budget
    at = first[:, None] + offsets
    row = np.where((at >= 0) & (at <= text.size), at if anchored else 0, far)
    padded = np.concatenate([text, [np.uint32(0xFFFF_FFFF)]])
    for i, c in enumerate(item.tolist()):
        there = at + i
        same = padded[np.where((there >= 0) & (there < text.size), there, text.size)] == c
        new = row + 1 - same
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a character of the item is left out
        new[(there + 1 < 0) | (there + 1 > text.size)] = far
        row = np.minimum.accumulate(new - offsets, axis=1) + offsets  # characters of the text are left out
    return row


def matches(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) in the normal text: the best region of each item within its budget, the
    first of these; if an item stands there more than once, only one of its regions is told."""
    found: dict[int, tuple[int, int, int, int]] = {}
    for item, start, end in items.whole_words(text):
        found.setdefault(item, (item, 0, start, end))
    chars = points(text)
    todo: dict[int, list[int]] = {}
    for i, first in items.bands(grams(chars)):
        todo.setdefault(i, []).append(first)
    for i, firsts in todo.items():
        item, most, name = items.chars[i], int(items.edits[i]), items.ids[i]
        start = text.find(items.texts[i])
        if start >= 0:  # no edits: nothing to align
            found[name] = min(found.get(name, (name, 1)), (name, 0, start, start + item.size))
            continue
        width = 2 * (most + 1) + 2 * most
        step = max(1, CELLS // width)
        for k in range(0, len(firsts), step):
            first = np.array(firsts[k : k + step]) - most
            row = banded(item, chars, first, width)
            best = row.argmin(axis=1)
            cost, end = row[np.arange(first.size), best], first + best + item.size
            b = int(np.lexsort((end, cost))[0])
            if cost[b] <= min(most, found.get(name, (0, most))[1]) and (name not in found or cost[b] < found[name][1]):
                # the same alignment backwards, from its end on, tells where it starts
                low = max(0, int(end[b]) - item.size - most)
                back = banded(item[::-1], chars[low : int(end[b])][::-1], np.array([-most]), 2 * most + 1, anchored=True)[0]
                found[name] = (name, int(cost[b]), int(end[b]) - (item.size - most + int(back.argmin())), int(end[b]))
            if name in found and found[name][1] == 0:
                break
    return sorted(found.values())


def searched(texts: list[str | None], items: Items) -> Iterator[list[tuple[int, int, int, int]]]:
    """``matches`` of each text. Several texts are looked through at once, a line each, for those that have
    a band at all (or one that a line's end spoils: such a text is only looked at again)."""
    lines, size = [], 0

    def out() -> Iterator[list[tuple[int, int, int, int]]]:
        starts = np.cumsum([0] + [len(t) + 1 for t in lines])
        near = [(first, int(items.length[i] + items.edits[i])) for i, first in items.bands(grams(points("\n".join(lines))))]
        some: set[int] = set()
        for first, reach in near:
            a, b = np.searchsorted(starts, [max(0, first), max(0, first + 2 * reach)], side="right")
            some.update(range(a - 1, b))
        for k, text in enumerate(lines):
            yield matches(text, items) if text and (k in some or items.short) else []

    for text in map(normal, texts):
        lines.append(text)
        size += len(text)
        if size >= LINES:
            yield from out()
            lines, size = [], 0
    yield from out()


def shares(benchmark: DataFrame, most: int) -> Iterator[tuple[Items, bool]]:
    """The items, share by share, and whether there is but one."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-chars // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield Items([(r.item_id, normal(r.text)) for r in (items.where(part == i) if n > 1 else items).toLocalIterator()]), n == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for each document and item with a region within the budget;
    ``start`` and ``end`` are characters of the normal text (lower case, white space as one space).

    Null and empty texts and items match nothing, nor do items with a null id. Items of equal text or
    equal id are each looked for. Repeated rows each get their matches; other columns are ignored. Whole
    texts of any length are searched; an empty table or benchmark gives no rows.
    """
    out = None
    for items, only in shares(benchmark, most):
        shipped = ship(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            items = received(shipped)
            for batch in batches:
                found = searched(batch.column(1).to_pylist(), items)
                rows = [(doc, *m) for doc, some in zip(batch.column(0).to_pylist(), found, strict=True) for m in some]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "edits", "start", "end"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, edits bigint, start bigint, end bigint")
        if only:
            return part
        part = durable(part)
        shipped.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns and other rows are unchanged, whatever they
    are called, so null and empty texts stay."""
    for items, only in shares(benchmark, most):
        shipped = ship(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            items = received(shipped)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not some for some in searched(texts, items)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = durable(docs)
            shipped.unpersist()
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
