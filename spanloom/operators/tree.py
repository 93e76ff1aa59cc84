"""Observation trees: nested by parent; orphans, and whatever has a cycle above it, are roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A row is (id, parent): the parent in the tree, null for roots; depth from 0; the place in depth-first
#: order; whether the row is a root; its children; and the place of the last row below it (or its own).
TREE = "project_id string, trace_id string, id string, parent_id string, depth int, place int, is_root boolean, n_children int, last int"


def _cyclic(parent: dict[str, str | None]) -> set[str]:
    """Ids that meet a cycle on their way up."""
    known: dict[str, bool] = {}
    for start in parent:
        path, at, seen = [], start, set()
        while at in parent and at not in known and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[at]
        bad = at in seen or known.get(at, False)
        known.update(dict.fromkeys(path, bad))
    return {k for k, bad in known.items() if bad}


def build(rows: list[tuple[str, str | None, object]]) -> list[tuple]:
    """(id, parent, depth, place, is root, children, last) of (id, parent, start); siblings by start, then id. Of
    rows with one id the last counts."""
    last = {r[0]: r for r in rows}
    parent = {i: (p if p in last else None) for i, p, _ in last.values()}
    for i in _cyclic(parent):
        parent[i] = None
    children: dict[str | None, list[str]] = {}
    for i in sorted(last, key=lambda i: (last[i][2], i)):
        children.setdefault(parent[i], []).append(i)
    out, stack = [], [(i, 0) for i in reversed(children.get(None, []))]
    while stack:
        i, depth = stack.pop()
        below = children.get(i, [])
        out.append((i, parent[i], depth, len(out), parent[i] is None, len(below)))
        stack += [(c, depth + 1) for c in reversed(below)]
    end = {r[0]: r[3] for r in out}
    for r in reversed(out):  # children come before their parents
        if r[1] is not None:
            end[r[1]] = max(end[r[1]], end[r[0]])
    return [(*r, end[r[0]]) for r in out]


def _roots_of_cycles(parent: np.ndarray) -> np.ndarray:
    """The parents (row numbers; the number of rows for none), where whatever has a cycle above it has none. Steps
    are doubled, so a chain of n takes log n rounds."""
    none = parent.size
    up = np.append(parent, none)
    for _ in range(max(1, none).bit_length() + 1):
        if (up == none).all():
            return parent
        up = up[up]
    return np.where(up[:-1] == none, parent, none)


def build_all(trace: np.ndarray, key: np.ndarray, above: np.ndarray) -> dict[str, np.ndarray]:
    """The trees of many traces at once, over rows that stand by trace, then start, then id. ``trace`` numbers
    traces, ``key`` and ``above`` number ids and parents (above -1: none), the same text having one number. Of rows
    with one id the last counts. Arrays by name: row (which of the rows), parent (which of them, -1 for
    roots), depth, place, n_children, last; a trace's rows stand in depth-first order."""
    codes = int(max(key.max(initial=0), above.max(initial=0))) + 1
    node = trace * codes + key
    by = np.argsort(node, kind="stable")
    row = np.sort(by[np.flatnonzero(np.append(node[by][1:] != node[by][:-1], True))]) if node.size else by
    trace, node, above = trace[row], node[row], above[row]
    n = row.size
    by = np.argsort(node)
    asked = trace * codes + above
    at = by[np.minimum(np.searchsorted(node[by], asked), max(0, n - 1))] if n else by
    parent = _roots_of_cycles(np.where((above >= 0) & (node[at] == asked), at, n) if n else at)
    depth, up, jump = np.zeros(n + 1, np.int64), np.append(parent, n), np.append((parent < n).astype(np.int64), 0)
    depth = jump
    while (up < n).any():
        depth = depth + depth[up]
        up = up[up]
    depth = depth[:-1]
    levels = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[levels], np.arange(depth.max(initial=0) + 2))
    size = np.ones(n + 1, np.int64)
    for d in range(ends.size - 2, 0, -1):  # a level's sizes go to the level above
        some = levels[ends[d] : ends[d + 1]]
        np.add.at(size, parent[some], size[some])
    # before a row come its elder siblings with all below them; roots of a trace are siblings
    family = np.where(parent < n, parent, n + trace)
    by = np.argsort(family, kind="stable")
    so_far = np.cumsum(size[by]) - size[by]
    begins = np.append(True, family[by][1:] != family[by][:-1])[:n]
    elder = np.empty(n, np.int64)
    elder[by] = so_far - np.repeat(so_far[begins], np.diff(np.append(np.flatnonzero(begins), n)))
    place = np.append(elder, -1)
    for d in range(1, ends.size - 1):
        some = levels[ends[d] : ends[d + 1]]
        place[some] = place[parent[some]] + 1 + elder[some]
    place, size = place[:-1], size[:-1]
    order = np.lexsort((place, trace))
    named = np.append(row, -1)
    found = {"row": row, "parent": named[parent], "depth": depth, "place": place, "n_children": np.bincount(parent, minlength=n + 1)[:n], "last": place + size - 1}
    return {k: v[order] for k, v in found.items()}


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers of texts, one text having one number in all the columns; -1 for null."""
    codes = pa.chunked_array(columns).cast(pa.large_string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _whole_traces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole traces, with the number of each row's trace; rows come in by trace."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not _same_trace(held[-1], batch):
            yield _numbered(pa.Table.from_batches(held))
            held = []
        trace = _numbered(batch)[1]
        cut = int(np.searchsorted(trace, trace[-1]))  # the last one may go on in the next batch
        if cut:
            yield _numbered(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _numbered(pa.Table.from_batches(held))


def _same_trace(one: pa.RecordBatch, two: pa.RecordBatch) -> bool:
    return all(one.column(c)[one.num_rows - 1].as_py() == two.column(c)[0].as_py() for c in (0, 1))


def _numbered(rows: pa.Table | pa.RecordBatch) -> tuple[pa.Table | pa.RecordBatch, np.ndarray]:
    edge = np.zeros(rows.num_rows, bool)
    for c in (0, 1):
        (codes,) = _numbers(rows.column(c) if isinstance(rows, pa.RecordBatch) else rows.column(c).combine_chunks())
        edge[1:] |= codes[1:] != codes[:-1]
    return rows, np.cumsum(edge)


def observation_tree(observations: DataFrame) -> DataFrame:
    """A row of TREE per live observation; of rows with one id the one that starts last counts. Traces stand in
    sorted partitions and go to Python many at a time, ids and times only. A trace isn't cut: traces are
    bounded by what one client sends."""
    names = ["project_id", "trace_id", "id", "parent_id", "depth", "place", "is_root", "n_children", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, trace in _whole_traces(batches):
            project, name, ids, above = (rows.column(c).combine_chunks() for c in range(4))
            made = build_all(trace, *_numbers(ids, above))
            row, parent = pa.array(made["row"]), made["parent"]
            ints = [pa.array(made[c], pa.int32()) for c in ("depth", "place", "n_children", "last")]
            columns = [project.take(row), name.take(row), ids.take(row), ids.take(pa.array(parent, mask=parent < 0)), ints[0], ints[1], pa.array(parent < 0), ints[2], ints[3]]
            yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=50_000)

    rows = observations.select("project_id", "trace_id", "id", "parent_observation_id", "start_time")
    placed = rows.repartition("project_id", "trace_id").sortWithinPartitions("project_id", "trace_id", "start_time", "id")
    return placed.drop("start_time").mapInArrow(run, TREE)


def visible(tree: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Rows in depth-first order without what lies under the collapsed (project_id, trace_id, id)."""
    key = ["project_id", "trace_id"]
    marked = tree.join(collapsed.withColumn("_shut", F.lit(True)), [*key, "id"], "left")
    # rows below a node stand right behind it, up to its last one
    before = W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    shut_to = F.max(F.when(F.col("_shut"), F.col("last"))).over(before)
    return marked.withColumn("_hidden", F.coalesce(shut_to >= F.col("place"), F.lit(False))).where("not _hidden").drop("_shut", "_hidden")
