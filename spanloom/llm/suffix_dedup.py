"""Repeated byte strings by a hash-compared suffix sort.

A string of ``least`` bytes is repeated if it also starts anywhere else, in this or another document.
Every such string holds an anchor: the place of its least gram hash (the leftmost, if tied). Equal
strings have equal anchors in equal places, so only suffixes with equal anchors need be compared. A
text falls into windows, the stretches of starts with one anchor:

1. Windows are counted by anchor and content hash, summed within tasks before the shuffle. Windows that
   occur twice are repeated whole; windows whose anchor no other window has hold nothing repeated.
2. The bytes of one occurrence of each remaining window meet the others of its anchor. Suffixes that
   begin at the anchors are put in order by a mergesort. A comparison finds the common extension by
   binary search over prefix polynomial hashes, so it takes a logarithm of its length. Common extensions
   of neighbours to both sides tell which starts are repeated; bytes verify what the hashes say.
   Starts whose twin isn't a neighbour are found by their strings' hashes, and verified as well.
3. An anchor of more windows than ``CROWD`` isn't put into one task: its ranges of starts are halved
   again and again, counting each half's whole stretch (found twice: all of it is repeated) and
   common core (found once: none of it is).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import durable, joined_bytes, pieces, table

LEAST, GRAM = 200, 32
#: Windows of an anchor that are sorted together at most (5 MB of bytes).
CROWD = 16_384
#: Bytes of text in a vectorised step (small enough for a core's cache), and starts of a text that are
#: looked at together at most.
STEP_BYTES, PIECE = 1 << 18, 1 << 18
#: Bytes of windows that are sorted together, about (runs of equal anchors stay whole).
SORT_BYTES = 4 << 20

#: Bases of the polynomial hashes, odd.
BASES = (0x9E37_79B9_7F4A_7C15, 0xC2B2_AE3D_27D4_EB4F)
_M1, _M2 = np.uint64(0xBF58_476D_1CE4_E5B9), np.uint64(0x94D0_49BB_1331_11EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, kept for the next call."""
    if base not in _powers or _powers[base][0].size < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(max(n, 1 << 19), np.uint64(b))
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers[base] = tuple(made)
    return tuple(x[:n] for x in _powers[base])


class Prefixes:
    """Prefix polynomial hashes of a byte array, modulo 2 to the 64."""

    def __init__(self, raw: np.ndarray, base: int):
        up, self.undo = powers(base, raw.size + 1)
        self.sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.undo[start]

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.undo[: self.sums.size - n]


def windows(raw: np.ndarray, bounds: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start in it, starts, anchor's place from the first start, anchor hash, content hash)
    of all windows of the texts that lie in ``raw`` end to end."""
    width = least - gram + 1
    if raw.size < least:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    one, two = (Prefixes(raw, b) for b in BASES)
    h = mix(one.grams(gram))
    low = np.uint64((1 << 24) - 1)
    best = (h & ~low) | np.arange(h.size, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: best.size - (width - reach)], best[width - reach :])
    anchor = (best & low).astype(np.int64)
    size = np.diff(bounds)
    starts = np.maximum(size - least + 1, 0)
    text = np.repeat(np.arange(size.size), starts)
    p = np.arange(text.size) - np.repeat(np.cumsum(starts) - starts, starts) + bounds[text]
    a = anchor[p]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))) if p.size else np.zeros(0, np.int64)
    n = np.diff(np.append(first, p.size))
    p0, a, text = p[first], a[first], text[first]
    place = a - p0
    content = mix(two.of(p0, n + least - 1) ^ (place * 1024 + n).astype(np.uint64))
    return text, p0 - bounds[text], n, place, h[a].view(np.int64), content.view(np.int64)


def text_windows(texts: DataFrame) -> DataFrame:
    """(k, p0, n, place, anchor, content) of (k, text), text in bytes."""
    fields = "k binary, p0 bigint, n int, place int, anchor bigint, content bigint"
    names = [f.split()[0] for f in fields.split(", ")]

    def made(keys: pa.Array, raw: np.ndarray, bounds: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
        text, p0, n, place, anchor, content = windows(raw, bounds)
        for at in range(0, text.size, 50_000):
            s = slice(at, at + 50_000)
            columns = [keys.take(pa.array(text[s])), pa.array(p0[s] + shift), pa.array(n[s].astype(np.int32)), pa.array(place[s].astype(np.int32)), pa.array(anchor[s]), pa.array(content[s])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", STEP_BYTES):
            raw, bounds = joined_bytes(batch.column("text"))
            if raw.size <= 2 * STEP_BYTES:
                yield from made(batch.column("k"), raw, bounds, 0)
                continue
            for i in range(batch.num_rows):  # a very long text goes piece by piece
                own = raw[bounds[i] : bounds[i + 1]]
                for at in range(0, max(1, own.size - LEAST + 1), PIECE):
                    part = own[at : at + PIECE + LEAST - 1]
                    yield from made(batch.column("k").slice(i, 1), part, np.array([0, part.size]), at)

    return texts.mapInArrow(run, fields)


class Shard:
    """Windows of several anchors, the windows of an anchor one after another."""

    def __init__(self, raw: np.ndarray, base: np.ndarray, n: np.ndarray, place: np.ndarray, run: np.ndarray, least: int = LEAST):
        self.raw, self.base, self.n, self.place, self.run, self.least = raw, base, n, place, run, least
        self.at = base + place
        self.right = n - 1 - place + least  # bytes from the anchor to the end of the last string
        self.hash = Prefixes(raw, BASES[0])

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Bytes that windows i and j have in common from their anchors on, or up to them."""
        low = np.zeros(i.size, np.int64)
        high = np.minimum(self.place[i], self.place[j]) if back else np.minimum(self.right[i], self.right[j])
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            x, y = (self.at[i] - mid, self.at[j] - mid) if back else (self.at[i], self.at[j])
            same = self.hash.of(x, mid) == self.hash.of(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            high = np.maximum(low, high)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix of window i comes before that of window j."""
        common = self.extension(i, j, False)
        ended_i, ended_j = common >= self.right[i], common >= self.right[j]
        last = self.raw.size - 1
        x, y = self.raw[np.minimum(self.at[i] + common, last)], self.raw[np.minimum(self.at[j] + common, last)]
        return np.where(ended_i | ended_j, ended_i & (~ended_j | or_equal), x < y)

    def ranks(self, i: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray, after_equal: bool) -> np.ndarray:
        """How many windows of order[low:high] come before each window i."""
        start = low.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            pick = np.flatnonzero(open_)
            goes = self.before(order[mid[pick]], i[pick], after_equal)
            low[pick] = np.where(goes, mid[pick] + 1, low[pick])
            high[pick] = np.where(goes, high[pick], mid[pick])
        return low - start

    def sorted(self) -> np.ndarray:
        """Windows in the order of their run, then of their suffixes: a bottom-up mergesort, every
        merge of a level at once."""
        m = self.run.size
        order = np.arange(m)
        new = np.concatenate(([True], self.run[1:] != self.run[:-1]))
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        ends = np.append(starts[1:], m)
        start, end = starts[of], ends[of]
        place = np.arange(m) - start
        width = 1
        while width < (ends - starts).max(initial=0):
            left = (place // width) % 2 == 0
            block = start + place // width * width
            other_low = np.where(left, np.minimum(block + width, end), block - width)
            other_high = np.where(left, np.minimum(block + 2 * width, end), block)
            rank = np.zeros(m, np.int64)
            for side, after_equal in ((left, False), (~left, True)):
                pick = np.flatnonzero(side & (other_low < other_high))
                rank[pick] = self.ranks(order[pick], other_low[pick].copy(), other_high[pick].copy(), order, after_equal)
            target = np.where(left, block, block - width) + (place % width) + rank
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order

    def equal_bytes(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes at x and y are the same over ``length``."""
        out = np.ones(x.size, bool)
        last = self.raw.size - 1
        for at in range(0, x.size, 20_000):
            s = slice(at, at + 20_000)
            reach = np.arange(length[s].max(initial=0))
            inside = reach < length[s, None]
            same = self.raw[np.minimum(x[s, None] + reach, last)] == self.raw[np.minimum(y[s, None] + reach, last)]
            out[s] = (same | ~inside).all(axis=1)
        return out

    def repeated(self) -> np.ndarray:
        """For every start of every window, in order, whether its string is repeated."""
        offset = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        order = self.sorted()
        pair = np.flatnonzero(self.run[order[1:]] == self.run[order[:-1]])
        i, j = order[pair], order[pair + 1]
        right, left = self.extension(i, j, False), self.extension(i, j, True)
        true = self.equal_bytes(self.at[i] - left, self.at[j] - left, left + right)
        low = np.maximum(self.least - right, np.maximum(self.place[i] - self.n[i], self.place[j] - self.n[j]) + 1)
        ok = true & (low <= left)
        change = np.zeros(total + 1, np.int64)
        for w in (i[ok], j[ok]):  # starts that lie low to left bytes before the anchor
            np.add.at(change, offset[w] + self.place[w] - left[ok], 1)
            np.add.at(change, offset[w] + self.place[w] - low[ok] + 1, -1)
        hit = np.cumsum(change)[:total] > 0
        size = np.bincount(self.run, minlength=self.run.max(initial=0) + 1)[self.run]
        if (size > 2).any() or not true.all():  # a twin may stand further off
            of = np.repeat(np.arange(self.n.size), self.n)
            use = np.flatnonzero((size > 2)[of] | (not true.all()))
            of = of[use]
            start = self.base[of] + use - offset[of]
            key = mix(self.hash.of(start, self.least) ^ self.run[of].astype(np.uint64) * _M2)
            by = np.argsort(key, kind="stable")
            same = np.flatnonzero((key[by][1:] == key[by][:-1]) & ~(hit[use[by[1:]]] & hit[use[by[:-1]]]))
            a, b = by[same], by[same + 1]
            sure = self.equal_bytes(start[a], start[b], np.full(a.size, self.least))
            hit[use[a[sure]]] = True
            hit[use[b[sure]]] = True
        return hit


def sorted_windows(found: DataFrame) -> DataFrame:
    """(anchor, content, mask) of (anchor, content, n, place, bytes): mask has a bit for each start that is
    repeated. Runs of an anchor stay together; a task holds about SORT_BYTES at a time."""

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchor = np.asarray(batch.column("anchor"))
        n = np.asarray(batch.column("n")).astype(np.int64)
        raw, bounds = joined_bytes(batch.column("bytes"))
        run = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]).astype(np.int64))))
        hit = Shard(raw, bounds[:-1], n, np.asarray(batch.column("place")).astype(np.int64), run).repeated()
        ends = np.cumsum(n)
        some = [k for k in range(n.size) if hit[ends[k] - n[k] : ends[k]].any()]
        masks = [np.packbits(hit[ends[k] - n[k] : ends[k]]).tobytes() for k in some]
        pick = pa.array(some, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("anchor").take(pick), batch.column("content").take(pick), pa.array(masks, pa.binary())], names=["anchor", "content", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= SORT_BYTES:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = np.asarray(whole.column("anchor"))
                last = np.flatnonzero(anchor != anchor[-1])
                cut = int(last[-1]) + 1 if last.size else 0
                if cut:
                    yield from solve(whole.slice(0, cut))
                held, size = [whole.slice(cut)], 0
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = found.select("anchor", "content", "n", "place", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "anchor bigint, content bigint, mask binary")


def halved_windows(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(anchor, content, low, high): the ranges of repeated starts, counted from the window's first, of
    (anchor, content, n, place, bytes), for anchors of any number of windows.

    A block holds the starts that lie ``far - size + 1`` to ``far`` bytes before the anchor, or those of
    them that the window has; sizes halve from round to round down to one start."""
    size = 1 << (least - 1).bit_length()
    blocks = found.select(
        "anchor", "content", F.lit(size - 1).alias("far"), F.col("place").alias("from"), (F.col("place") - F.col("n") + 1).alias("to"), "place", "bytes"
    )
    out = None
    while size >= 1:
        # from >= to: bytes before the anchor of the first and last start that the window has here
        hull = F.substring("bytes", F.col("place") - F.col("from") + 1, F.col("from") - F.col("to") + least)
        core = F.md5(F.substring("bytes", F.col("place") - (F.col("far") - size + 1) + 1, F.lit(least - size + 1))) if size <= least else F.lit("")
        keyed = blocks.withColumns({"hull": F.md5(hull), "core": core})
        whole = keyed.groupBy("anchor", "from", "to", "hull").agg(F.count("*").alias("wholes"), F.min("content").alias("lead"))
        parts = keyed.groupBy("anchor", "far", "core").agg(F.count("*").alias("cores"))
        told = durable(keyed.join(whole, ["anchor", "from", "to", "hull"]).join(parts, ["anchor", "far", "core"]).select(*blocks.columns, "wholes", "lead", "cores"))
        done = told.where("wholes > 1").select("anchor", "content", (F.col("place") - F.col("from")).alias("low"), (F.col("place") - F.col("to")).alias("high"))
        out = done if out is None else out.unionByName(done)
        half = size // 2
        # of blocks that are told, one each stays: part of another block may have its twin there
        rest = told.where("cores > 1 and (wholes = 1 or content = lead)").drop("wholes", "lead", "cores")
        if not half or not rest.head(1):
            break
        sides = F.explode(F.array(F.col("far"), F.col("far") - half))
        rest = rest.withColumn("side", sides).withColumns({"from": F.least("from", "side"), "to": F.greatest("to", F.col("side") - half + 1), "far": F.col("side")})
        blocks, size = rest.where(F.col("from") >= F.col("to")).select(*blocks.columns), half
    return out


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted windows: (anchor, content, crowd, n, place, bytes)."""
    fields = "anchor bigint, content bigint, crowd boolean, n int, place int, bytes binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpack.decompress(batch.column("z")[i].as_py())
                rows = batch.column("wanted")[i].values.flatten()  # the struct's fields in order
                p0, n, place, anchor, content, crowd = rows
                cuts = [text[a : a + m + LEAST - 1] for a, m in zip(p0.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, content, crowd, n, place, pa.array(cuts, pa.binary())], names=names)

    each = wanted.groupBy("k").agg(F.collect_list(F.struct("p0", "n", "place", "anchor", "content", "crowd")).alias("wanted"))
    return texts.groupBy("k").agg(F.first("z").alias("z")).join(each, "k").select("z", "wanted").mapInArrow(run, fields)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, z): k tells texts apart, z is the text compressed for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            made = [pack.compress(memoryview(t.as_buffer())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(made, pa.binary())], names=["doc_id", "k", "z"])

    return docs.mapInArrow(run, "doc_id bigint, k binary, z binary")


def repeated_ranges(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(k, marks): for each text with repeated strings the list of (p0, n, mask) of its windows; a null mask
    means every start."""
    found = durable(text_windows(docs.select("k", "text")))
    distinct = found.groupBy("anchor", "content").agg(F.count("*").alias("c"))
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("g"), F.sum("c").alias("all"))
    known = distinct.join(shared, "anchor").where("c > 1 or g > 1").select("anchor", "content", "c", "g")
    occurring = durable(found.join(known, ["anchor", "content"]))
    one = F.min(F.struct("k", "p0", "n", "place")).alias("one")
    wanted = occurring.where("g > 1").groupBy("anchor", "content").agg(one, (F.first("g") > CROWD).alias("crowd")).select("anchor", "content", "crowd", "one.*")
    contexts = durable(_contexts(packed, wanted))
    ranges = [F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high")]
    verdict = sorted_windows(contexts.where("not crowd")).select("anchor", "content", "mask", *ranges)
    crowds = contexts.where("crowd")
    if crowds.head(1):
        verdict = verdict.unionByName(halved_windows(crowds).withColumn("mask", F.lit(None).cast("binary")))
    whole = occurring.where("c > 1").select("k", "p0", "n", F.lit(None).cast("binary").alias("mask"))
    alone = occurring.where("c = 1").select("k", "p0", "n", "anchor", "content").join(verdict, ["anchor", "content"])
    first, count = F.col("p0") + F.coalesce("low", F.lit(0)), F.coalesce(F.col("high") - F.col("low") + 1, F.col("n"))
    marks = whole.unionByName(alone.select("k", first.alias("p0"), count.cast("int").alias("n"), "mask"))
    return marks.groupBy("k").agg(F.collect_set(F.struct("p0", "n", "mask")).alias("marks"))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("k", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def cover(size: int, marks: list[tuple[int, int, bytes | None]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and last bounds of the maximal removed runs."""
    change = np.zeros(size + 1, np.int64)
    for p0, n, mask in marks:
        if mask is None:
            change[p0] += 1
            change[p0 + n - 1 + least] -= 1
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n)) + p0
            np.add.at(change, at, 1)
            np.add.at(change, at + least, -1)
    edge = np.diff(np.concatenate(([False], np.cumsum(change)[:size] > 0, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): for each row of ``docs`` the maximal runs of bytes that a
    repeated string of LEAST bytes covers, as ``start, end, start, end ...``, and the remaining bytes.

    Null text counts as empty; texts under LEAST bytes lose nothing. Repeated rows each get their row and
    lose all that lies in repeated strings; a null doc_id stays null. Other columns are ignored; an empty
    table gives no rows. Whole texts count, of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, kept = [], [], []
            for z, marks in zip(batch.column("z"), batch.column("marks"), strict=True):
                text = unpack.decompress(z.as_py())
                first, last = cover(len(text), [tuple(m.values()) for m in marks.as_py() or ()])
                keep = [text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)]
                sizes.append(len(text))
                removed.append(np.stack([first, last], axis=1).ravel())
                kept.append(b"".join(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"]
            )

    rows = keyed(docs)
    packed = _packed(rows)
    marked = packed.join(repeated_ranges(rows, packed), "k", "left").select("doc_id", "z", "marks")
    return marked.mapInArrow(run, "doc_id bigint, n_bytes bigint, removed array<bigint>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
