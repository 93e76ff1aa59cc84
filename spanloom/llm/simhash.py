"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into few segments, so few that for any two linked fingerprints one
segment differs in at most one bit (``bits // segments <= 1``). Each fingerprint is indexed once
for every bit of every segment, with that bit left out; two fingerprints with such a segment meet
under at least one key. Keys are joined by equality (shuffle and sort), and every meeting is
verified on the whole fingerprints. Equal fingerprints are one entry of the index, so groups of
exact copies cost one row; a crowded key is searched breadth-first over the members not yet
reached, which is close to linear when they are near each other, and gives a spanning set of
links and never all pairs.

``drop_near_copies`` links texts by the similarity of their shingle sets. Fingerprints that are near by
deletion variants are compared first and bring most copies together; but at a similarity of 0.8
fingerprints differ in ten bits or more, which no selective key reaches, so the texts that are still apart
are joined by prefix filtering, which loses none. Every link is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.llm.common import durable, forget, pieces, table, unused
from spanloom.llm.components import components

#: Fixed value: the seed of the hash of a shingle.
SEED = 42
#: Runs of a key up to this length are compared pair by pair; longer ones breadth-first.
SHORT_RUN = 48
#: One text in LOOK tells which shingles are frequent; so many of these are known at most.
LOOK, MOST_FREQUENT = 8, 1_000_000
#: Nodes whose ids are broadcast at most, to tell whose sets are needed.
BROADCAST_IDS = 1_000_000
#: The same for keys of prefixes: a run's members are often all alike.
FEW = 8
#: Members of a crowded key that the others are compared with before all that are left are.
HUBS = 4
#: Bits of a set's sketch: the parity of the number of its shingles in each of so many bins.
SKETCH = 512
#: Against rounding where a bound is met exactly.
EPS = 1e-9


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles in order, repeats included; fewer words make one shingle."""
    parts = text.lower().split()  # bytes: lowers A-Z only and parts at ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    n = max(1, len(parts) - words + 1)
    stops = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), dtype=np.uint64, count=n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the hashes; none gives zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):  # very long texts
        some = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > hashes.size, bitorder="little")
    return int(bits.view("<i8")[0])


def text_fingerprint(text: bytes, words: int, seed: int = SEED) -> int:
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int, carry: str = "doc_id") -> DataFrame:
    """(``carry``, fp): one row per document; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = [text_fingerprint(t.as_py() or b"", words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[carry, "fp"])

    kind = docs.schema[carry].dataType.simpleString()
    return docs.select(carry, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{carry} {kind}, fp bigint")


def segments_of(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one must differ in at most one bit."""
    n = bits // 2 + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(nodes: DataFrame, bits: int) -> DataFrame:
    """(hole, kept, fp, node): every fingerprint under each of its 64 one-wildcard keys."""
    masks = []
    for first, width in segments_of(bits):
        whole = ((1 << width) - 1) << first
        masks += [(whole & ~(1 << b)) for b in range(first, first + width)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    array = F.array(*[F.lit(m).cast("bigint") for m in signed])
    return nodes.select("fp", "node", F.posexplode(array).alias("hole", "mask")).select(
        F.col("hole").cast("tinyint").alias("hole"), F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), "fp", "node"
    )


def _crowd(fp: np.ndarray, bits: int, each: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (as places) of one crowded key, breadth-first over the members still looked for: each is
    reached ``each`` times before it counts as found, and once reached it looks for others itself."""
    left, right = [], []
    reached = np.zeros(fp.size, np.int64)
    looked = np.zeros(fp.size, bool)
    rest = np.arange(fp.size)
    while rest.size > 1:
        queue = [int(rest[0])]
        while queue and rest.size:
            x = queue.pop()
            if looked[x]:
                continue
            looked[x] = True
            rest = rest[rest != x]
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= bits
            found = rest[near]
            if found.size:
                left.append(np.full(found.size, x))
                right.append(found)
                queue.extend(found[reached[found] == 0].tolist())
                reached[found] += 1
                rest = rest[reached[rest] < each]
    return left, right


def _meetings(hole: np.ndarray, kept: np.ndarray, fp: np.ndarray, bits: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (as places) of whole runs of equal keys."""
    new = np.flatnonzero((hole[1:] != hole[:-1]) | (kept[1:] != kept[:-1])) + 1
    starts = np.concatenate(([0], new))
    lengths = np.diff(np.concatenate((starts, [fp.size])))
    left, right = [], []
    for at in np.flatnonzero(lengths > SHORT_RUN):
        a, b = _crowd(fp[starts[at] : starts[at] + lengths[at]], bits, each)
        left += [x + starts[at] for x in a]
        right += [x + starts[at] for x in b]
    run = np.repeat(np.arange(starts.size), lengths)
    use = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths))
    run, few = run[use], fp[use]
    for step in range(1, SHORT_RUN):
        if few.size <= step:
            break
        same = run[step:] == run[:-step]
        if not same.any():
            break
        ok = same & (np.bitwise_count(few[step:] ^ few[:-step]) <= bits)
        left.append(use[:-step][ok])
        right.append(use[step:][ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(nodes: DataFrame, bits: int, each: int = 1) -> DataFrame:
    """(u, v): links between nodes whose fingerprints differ in at most ``bits`` bits; ``nodes``: (fp,
    node). With ``each`` of 1, enough of them to hold every component together; a higher one gives
    members of crowded keys that many links, for callers that verify them further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            hole, kept, fp, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = _meetings(hole, kept, fp.view(np.uint64), bits, each)
            if a.size:
                pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            hole, kept, fp, node = (np.asarray(batch.column(i)).astype(np.int64) for i in range(4))
            if held and (held[-1][0][-1] != hole[0] or held[-1][1][-1] != kept[0]):
                yield from out(held)
                held = []
            last = np.flatnonzero((hole != hole[-1]) | (kept != kept[-1]))
            cut = int(last[-1]) + 1 if last.size else 0  # the last run may go on
            if cut:
                yield from out([*held, (hole[:cut], kept[:cut], fp[:cut], node[:cut])])
                held = []
            held.append((hole[cut:], kept[cut:], fp[cut:], node[cut:]))
        if held:
            yield from out(held)

    spread = variants(nodes, bits).repartition("hole", "kept").sortWithinPartitions("hole", "kept", "fp")
    return spread.mapInArrow(run, "u bigint, v bigint").where("u <> v").distinct()


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): every document with the smallest doc_id that it reaches over
    links of at most ``bits`` differing bits.

    Null text and text without words have fingerprint zero and are linked like any other. Rows
    with a null doc_id are kept and may take another row's component; repeated rows share one.
    Only doc_id and text are read; an empty table gives no rows.
    """
    prints = durable(fingerprints(docs, words))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp", F.col("fp").alias("node")), bits))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that stand in many texts, in order, and in how many of the texts looked at (one in
    ``LOOK``). They only order shingles; no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch], "text"):
                made = [np.unique(shingle_hashes(t.as_py() or b"", words)) for t in part.column("text")]
                found, n = np.unique(np.concatenate(made), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(LOOK)) == 0).select(F.col("text").cast("binary").alias("text"))
    counts = some.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = np.asarray(top.column("h").combine_chunks()).view(np.uint64), np.asarray(top.column("n").combine_chunks())
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The rarest shingles of a set, so many that any set with a similarity of ``least`` has one of them
    among its own rarest; an empty set has the shingle 0."""
    if not found.size:
        return np.zeros(1, np.uint64)
    known, counts = common
    if known.size:
        at = np.minimum(np.searchsorted(known, found), known.size - 1)
        found = found[np.argsort(np.where(known[at] == found, counts[at], 0), kind="stable")]
    return found[: found.size - math.ceil(least * found.size - EPS) + 1]


def sketch_of(found: np.ndarray) -> bytes:
    """Parities of a set of hashes by bin. Two sets differ in at least as many members as their sketches in bits."""
    bins = (found >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _sketches_allow(a: np.ndarray, b: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Which pairs the sketches leave possible: sets that are alike differ in few of their members, ``size`` in all."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= ((1 - least) / (1 + least) + 1e-6) * size + EPS


def _near(size: np.ndarray, sketch: np.ndarray, x: int, other: np.ndarray, least: float) -> np.ndarray:
    """Which of the others the sketches leave possible for x."""
    return _sketches_allow(sketch[other], sketch[x], size[other] + size[x], least)


def prefixes(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(node, key, first, fp, size, keys, sketch) of the distinct texts of (key, first, text): a number, the smallest
    ``first``, the fingerprint, the number of distinct shingles of ``words`` words, the prefix (8 bytes
    each) and the set's sketch. Written; texts themselves aren't shuffled."""
    shipped = texts.sparkSession.sparkContext.broadcast(frequent(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in pieces(batches, "text"):
            made = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                if key not in known:
                    if len(known) >= 1000:  # copies often stand together
                        known.clear()
                    hashes = shingle_hashes(text.as_py() or b"", words)
                    own = np.unique(hashes)
                    known[key] = (fingerprint_of(hashes), own.size, prefix_of(own, shipped.value, least).tobytes(), sketch_of(own))
                made.append(known[key])
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("first"), *columns], names=["key", "first", "fp", "size", "keys", "sketch"])

    fields = StructType([*texts.schema.fields[:2], *StructType.fromDDL("fp bigint, size int, keys binary, sketch binary").fields])
    made = texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, fields)
    each = made.groupBy("key").agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "keys", "sketch")])
    return durable(each.withColumn("node", F.monotonically_increasing_id()))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of (node, text): the 64-bit hashes of all shingles, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [np.unique(shingle_hashes(t.as_py() or b"", words)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node bigint, shingles binary")


def alike(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two whole shingle sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not x.size and not y.size:
        return 1.0
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared / (both.size - shared)


def few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """A written table of one row (``n`` in all, if known) a node: broadcast up to BROADCAST_IDS rows, else left to Spark's joins."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= BROADCAST_IDS else rows


def hashed(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of columns, which are broadcast in their place: a table by one long holds the fewest bytes, and
    the driver holds it."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def same(a: Column, a2: Column, b: Column, b2: Column) -> Column:
    """Whether both hashes agree. Only the first one is the join's key."""
    return (a == b) & (a2.bitwiseXOR(b2) == 0)


def verified(found: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The links of ``found`` whose shingle sets have a similarity of ``least`` or more, written. Links go first whose
    sketches show that the sets differ too much; sets are made anew from the texts that are in the others, so that no
    table of all sets is kept, and are shuffled for the comparison alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(a.as_py(), b.as_py()) >= least - EPS for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for i in (4, 5))
                size = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
                yield batch.select(["u", "v"]).filter(pa.array(_sketches_allow(u, v, size, least)))

    both = lambda: found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).distinct()
    found = durable(found.select("u", "v").distinct())
    ends = durable(nodes.select("node", "size", "sketch").join(both(), "node", "left_semi"))
    one = found.join(ends.withColumnsRenamed({"node": "u", "size": "size_u", "sketch": "sketch_u"}), "u")
    one = one.join(ends.withColumnsRenamed({"node": "v", "size": "size_v", "sketch": "sketch_v"}), "v")
    all_, found = found, durable(one.select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v").mapInArrow(possible, "u bigint, v bigint"))
    forget(all_, ends)
    a, b = hashed(F.col("key"), F.col("first"))
    ids = durable(nodes.select("node", a.alias("id"), b.alias("id2")).join(both(), "node", "left_semi"))
    n = ids.count()
    wanted = few(ids, n)
    at = durable(shingle_sets(texts.join(wanted, same(*hashed(texts["key"], texts["first"]), wanted["id"], wanted["id2"])).select("node", "text"), words))
    if at.count() > n:  # equal rows give a set each: one of them stays
        all_, at = at, durable(at.groupBy("node").agg(F.first("shingles").alias("shingles")))
        forget(all_)
    one = found.join(at.withColumnsRenamed({"node": "u", "shingles": "a"}), "u")
    one = one.join(at.withColumnsRenamed({"node": "v", "shingles": "b"}), "v").select("u", "v", "a", "b")
    sure = durable(one.mapInArrow(run, "u bigint, v bigint"))
    forget(found, ids, at)
    return sure


def _possible(size: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether members (places) can be alike if the shingle they meet at is the first that they share: true
    at the first shared shingle of any two that are alike, so no such pair is lost."""
    shared = np.minimum(size[a] - pos[a], size[b] - pos[b])
    return shared >= least / (1 + least) * (size[a] + size[b]) - EPS


def _across(node: np.ndarray, size: np.ndarray, pos: np.ndarray, root: np.ndarray, least: float, step: int, sketch: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs (as places) of members of one crowded key that aren't in one component yet: those with a few
    members (the same ones under every key, others each ``step``), or, with a ``step`` of -1, all that their
    sketches leave possible."""
    names, of, n = np.unique(root, return_inverse=True, return_counts=True)
    if names.size < 2:
        return [], []
    places = np.arange(node.size)
    if step < 0:
        outside = places[of != n.argmax()]
        rank = np.full(node.size, -1)
        rank[outside] = np.arange(outside.size)
    else:
        mixed = (node.view(np.uint64) ^ np.uint64(step)) * np.uint64(0x9E37_79B9_7F4A_7C15)
        outside = np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")[:HUBS]
    left, right = [], []
    for x in outside.tolist():
        other = places[of != of[x]]
        if step < 0:
            other = other[(rank[other] < 0) | (rank[other] > rank[x])]
        other = other[_possible(size, pos, np.full(other.size, x), other, least)]
        if sketch is not None:
            other = other[_near(size, sketch, x, other, least)]
        left.append(np.full(other.size, x))
        right.append(other)
    return left, right


def prefix_pairs(spread: DataFrame, least: float, step: int) -> DataFrame:
    """(u, v, key, size, pos) of (key, node, size, pos, root), and a sketch if there is one: the pairs that meet
    under a key and can be alike, key null. Of keys of over FEW members only some of the pairs, see ``_across``; with a
    ``step`` of 0 their members come too, v null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            key, node, size, pos, root, *sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            lengths = np.diff(np.concatenate((starts, [key.size])))
            left, right = [], []
            for at in np.flatnonzero(lengths > FEW):
                inside = slice(starts[at], starts[at] + lengths[at])
                a, b = _across(node[inside], size[inside], pos[inside], root[inside], least, step, *[s[inside] for s in sketch])
                left += [x + starts[at] for x in a]
                right += [x + starts[at] for x in b]
            run_of = np.repeat(np.arange(starts.size), lengths)
            use = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= FEW), lengths))
            for back in range(1, FEW):
                if use.size <= back:
                    break
                a, b = use[:-back], use[back:]
                same = run_of[a] == run_of[b]
                if not same.any():
                    break
                same &= root[a] != root[b]
                a, b = a[same], b[same]
                ok = _possible(size, pos, a, b, least)
                left.append(a[ok])
                right.append(b[ok])
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            made = [[pa.array(pairs[0]), pa.array(pairs[1]), none, none, none]]
            if step == 0:
                crowd = np.flatnonzero(np.repeat(lengths > FEW, lengths))
                made.append([pa.array(node[crowd]), pa.nulls(crowd.size, pa.int64()), pa.array(key[crowd]), pa.array(size[crowd]), pa.array(pos[crowd])])
            for columns in made:
                if len(columns[0]):
                    yield from pa.Table.from_arrays(columns, names=["u", "v", "key", "size", "pos"]).to_batches(max_chunksize=50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(np.asarray(batch.column(i)).astype(np.int64) for i in range(5))
            if batch.num_columns > 5:
                rows += (np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, SKETCH // 64),)
            if held and held[-1][0][-1] != rows[0][0]:
                yield from out(held)
                held = []
            last = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(last[-1]) + 1 if last.size else 0  # the last run may go on
            if cut:
                yield from out([*held, tuple(x[:cut] for x in rows)])
                held = []
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield from out(held)

    dealt = spread.select("key", "node", "size", "pos", "root", *[c for c in spread.columns if c == "sketch"]).repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "u bigint, v bigint, key bigint, size bigint, pos bigint")


def near_roots(nodes: DataFrame, texts: DataFrame, words: int, least: float, bits: int = 4) -> DataFrame:
    """(node, root) of all nodes that have a link: ``nodes`` is what ``prefixes`` makes of ``texts``.

    Nothing is lost: two sets with a similarity of ``least`` share a shingle of their prefixes. What near
    fingerprints have brought together counts as one then. Crowded keys send pairs with a few members
    first, and in the last step all pairs that are still apart are compared, but for those whose sketches show that
    they differ in too many shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "keys"):
            keys = [np.frombuffer(k.as_py(), np.int64) for k in batch.column("keys")]
            n = [k.size for k in keys]
            node, size, root = (np.repeat(np.asarray(batch.column(i)), n) for i in range(3))
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), node, size, pos, root)], names=["key", "node", "size", "pos", "root"])

    sure = lambda pairs: verified(pairs, nodes, texts, words, least)
    roots = components(sure(links(nodes.select("fp", "node"), bits)))
    rooted = nodes.select("node", "size", "keys").join(few(roots), "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), "keys")
    met = durable(prefix_pairs(rooted.mapInArrow(run, "key bigint, node bigint, size int, pos int, root bigint"), least, 0))
    crowd = met.where("v is null").select("key", F.col("u").alias("node"), "size", "pos")
    roots = components(roots.union(sure(met.where("v is not null"))))
    if not crowd.isEmpty():
        for step in (1, -1):
            rooted = crowd.join(few(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
            if step < 0:  # sketches go to keys only whose members are still apart
                apart = rooted.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
                rooted = rooted.join(apart, "key", "left_semi").join(nodes.select("node", "sketch"), "node")
            roots = components(roots.union(sure(prefix_pairs(rooted, least, step))))
    forget(met)
    return roots


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id, then
    the smallest row of it by a hash; of equal rows any.

    Texts are linked if their sets of ``words``-word shingles have a similarity of ``least`` or more, at any
    length, see ``near_roots``. Equal texts (by a 128-bit hash) are one node, and null text counts as
    empty; so do texts without words, which are alike. A null doc_id comes last. Columns stay as they
    are, whatever they are called; an empty table gives no rows.
    """
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64(*plain).alias("row"), F.xxhash64(F.lit(1), *plain).alias("row2"))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), first.alias("first"), text.alias("text"))
    nodes = prefixes(texts, words, least)
    roots = near_roots(nodes, texts, words, least)
    rooted = nodes.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    mark, mark2, twin = (unused(c, docs) for c in ("mark", "mark2", "twin"))
    a, b = hashed(F.col("first"))
    kept = durable(rooted.groupBy("root").agg(F.min("first").alias("first")).select(a.alias("id"), b.alias("id2")))
    # a broadcast known before the rows move, or one exchange for join and window: never an exchange for each
    a, b = hashed(first)
    left, wanted = docs.withColumns({mark: a, mark2: b}), few(kept)
    left = left.join(wanted, same(left[mark], left[mark2], wanted["id"], wanted["id2"]), "left_semi")
    return left.withColumn(twin, F.row_number().over(W.partitionBy(mark, mark2).orderBy(F.lit(1)))).where(F.col(twin) == 1).select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 4-word shingles, linked at 4 or fewer differing bits."""
    return near_groups(table(spark, sf_dir, "documents"), words=4, bits=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
