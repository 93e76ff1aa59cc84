"""Messages of a model's input and output, read from span attributes within budgets.

An attribute is read on its own first: what it costs in bytes and nodes, and its messages if it keeps its own bounds.
Then an export's attributes are added up in order, and one counts only if the export's budget lasts to its end. What
an attribute that failed has cost is spent all the same. So no state passes between spans but a running sum.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import attributes as A

#: Bytes and nodes of an attribute and of an export, messages of a list and parts of all its messages.
MOST_BYTES, MOST_NODES, EXPORT_BYTES, EXPORT_NODES = 128 * 1024, 10_000, 512 * 1024, 50_000
MOST_MESSAGES, MOST_PARTS = 200, 200
#: Whole numbers beyond this aren't exact where numbers are doubles; they stay text.
EXACT = 2**53 - 1

READ = "text string, bytes bigint, nodes bigint"


class Spent(Exception):
    """An attribute's own budget is used up, or it holds no value."""


class Reader:
    """Reads one attribute and counts what that costs."""

    def __init__(self):
        self.bytes = self.nodes = 0

    def node(self) -> None:
        self.nodes += 1
        if self.nodes > MOST_NODES:
            raise Spent

    def text(self, s: str) -> str:
        self.bytes += len(s.encode("utf-8", "surrogatepass"))
        if self.bytes > MOST_BYTES:
            raise Spent
        return s

    def json(self, s: str) -> object:
        """JSON in a string: beyond the bound it costs nothing; what isn't JSON costs its bytes."""
        size = len(s.encode("utf-8", "surrogatepass"))
        if size > MOST_BYTES:
            raise Spent
        self.bytes = size
        found = json.loads(s, parse_int=_whole, parse_float=_real, parse_constant=_refused)
        todo = [found]
        while todo:
            if self.nodes == MOST_NODES:
                raise Spent
            self.nodes += 1
            v = todo.pop()
            todo += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return found

    def value(self, v: object) -> object:
        """A typed attribute value as plain data."""
        if not isinstance(v, dict):
            raise Spent
        self.node()
        if isinstance(v.get("stringValue"), str):
            return self.text(v["stringValue"])
        if isinstance(v.get("boolValue"), bool):
            return v["boolValue"]
        if isinstance(v.get("doubleValue"), int | float) and not isinstance(v["doubleValue"], bool):
            return _plain(float(v["doubleValue"]))
        if isinstance(v.get("bytesValue"), str):
            return self.text(v["bytesValue"])
        number = v.get("intValue")
        if isinstance(number, str):
            return _integer(self.text(number))
        if isinstance(number, int) and not isinstance(number, bool):
            return number if abs(number) <= EXACT else str(number)
        for kind in ("arrayValue", "kvlistValue"):
            if isinstance(v.get(kind), dict):
                values = v[kind].get("values")
                if values is not None and not isinstance(values, list):
                    raise Spent
                return [self.value(x) for x in values or ()] if kind == "arrayValue" else self.pairs(values or ())
        raise Spent

    def pairs(self, entries: list) -> dict:
        out: dict = {}
        for e in entries:
            if not isinstance(e, dict) or not isinstance(e.get("key"), str) or e["key"] in out:
                raise Spent
            key = self.text(e["key"])
            out[key] = self.value(e.get("value"))
        return out


def _whole(s: str) -> object:
    return int(s) if len(s) < 18 and abs(int(s)) <= EXACT else s


def _plain(x: float) -> object:
    return int(x) if x.is_integer() and abs(x) <= EXACT else x


def _real(s: str) -> object:
    x = float(s)
    return s if not math.isfinite(x) or (x.is_integer() and abs(x) > EXACT) else _plain(x)


def _refused(name: str) -> object:
    raise ValueError(name)


def _integer(s: str) -> object:
    try:
        n = int(s) if len(s) <= 64 else None
    except ValueError:
        return s
    return n if n is not None and abs(n) <= EXACT else s


def are_messages(found: object, output: bool) -> bool:
    """A list of messages with a role and typed parts; those of an output say why they ended."""
    if not isinstance(found, list) or len(found) > MOST_MESSAGES:
        return False
    parts = 0
    for m in found:
        if not isinstance(m, dict) or not isinstance(m.get("role"), str) or not isinstance(m.get("parts"), list) or (output and not isinstance(m.get("finish_reason"), str)):
            return False
        parts += len(m["parts"])
        if parts > MOST_PARTS or not all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in m["parts"]):
            return False
    return True


def read(flat: str | None, nested: str | None, output: bool) -> tuple[str | None, int, int]:
    """(messages as JSON text or None, bytes, nodes) of one attribute: JSON in a string, or a nested value as JSON."""
    reader, found = Reader(), None
    try:
        if flat is not None:
            found = reader.json(flat)
        elif nested is not None:
            found = reader.value(json.loads(nested))
    except (Spent, ValueError, RecursionError):
        found = None
    told = json.dumps(found, ensure_ascii=False, separators=(",", ":")) if are_messages(found, output) else None
    return told, reader.bytes, reader.nodes


def _reader(output: bool):
    @F.pandas_udf(READ)
    def run(flat: pd.Series, nested: pd.Series) -> pd.DataFrame:
        made = pd.DataFrame({"text": None, "bytes": 0, "nodes": 0}, index=flat.index)
        some = flat.notna() | nested.notna()  # few spans hold messages; to read nothing costs nothing
        if some.any():
            rows = [read(a if isinstance(a, str) else None, b if isinstance(b, str) else None, output) for a, b in zip(flat[some], nested[some], strict=True)]
            made.loc[some, ["text", "bytes", "nodes"]] = pd.DataFrame(rows, columns=["text", "bytes", "nodes"], index=made.index[some]).astype(object)
        return made

    return run


def _nested(v: Column) -> Column:
    """A nested value of an attribute as the JSON it came as."""
    wrap = lambda kind: F.when(v[kind].isNotNull(), F.concat(F.lit(f'{{"{kind}":'), v[kind], F.lit("}")))
    return F.coalesce(wrap("arrayValue"), wrap("kvlistValue"))


def with_messages(spans: DataFrame, attributes: Column, keys: tuple[str, str], export: list) -> DataFrame:
    """``spans`` with ``input_messages`` and ``output_messages``; ``export`` names what one export's spans share, and
    ``place`` gives their order. An export is one event of a batch, so its spans are few."""
    parts = []
    for name, key in zip(("_in", "_out"), keys, strict=True):
        v = A.value_of(attributes, key)
        parts.append((name, _reader(name == "_out")(v["stringValue"], _nested(v))))
    out = spans.withColumns(dict(parts))
    before = W.partitionBy(*export).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    spent = {k: F.coalesce(F.sum(F.col(f"_in.{k}") + F.col(f"_out.{k}")).over(before), F.lit(0)) for k in ("bytes", "nodes")}
    out = out.withColumns({f"_{k}": v for k, v in spent.items()})

    def lasting(name: str, earlier: str | None) -> Column:
        so_far = {k: F.col(f"_{k}") + (F.col(f"{earlier}.{k}") if earlier else F.lit(0)) for k in ("bytes", "nodes")}
        fits = [so_far[k] + F.col(f"{name}.{k}") <= most for k, most in (("bytes", EXPORT_BYTES), ("nodes", EXPORT_NODES))]
        left = [so_far[k] < most for k, most in (("bytes", EXPORT_BYTES), ("nodes", EXPORT_NODES))]
        return F.when(fits[0] & fits[1] & left[0] & left[1], F.col(f"{name}.text"))

    return out.withColumns({"input_messages": lasting("_in", None), "output_messages": lasting("_out", "_in")}).drop("_in", "_out", "_bytes", "_nodes")
