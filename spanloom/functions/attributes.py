"""Readers of attribute lists: array<struct<key, value<stringValue, intValue, doubleValue, ...>>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used; inside higher-order functions Spark computes
    equal expressions again."""
    return F.transform(F.array(value), use)[0]


def firsts(attributes: Column) -> Column:
    """Values by key; of repeated keys the first counts."""
    keys = F.transform(attributes, lambda a: a["key"])
    first = let(keys, lambda k: F.filter(attributes, lambda a, i: F.array_position(k, a["key"]) == i + 1))
    return F.map_from_entries(F.transform(first, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"))))


def number(value: Column) -> Column:
    return F.coalesce(value["doubleValue"], value["intValue"].try_cast("double"))


def value_of(attributes: Column, key: str) -> Column:
    """The value of the first attribute with this key."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(1))["value"]


def string_of(attributes: Column, key: str) -> Column:
    return value_of(attributes, key)["stringValue"]


def number_of(attributes: Column, key: str) -> Column:
    return number(value_of(attributes, key))


def text_of(value: Column) -> Column:
    """Any value as text; nested ones stay JSON."""
    fields = ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue", "bytesValue")
    return F.coalesce(*[value[f].cast("string") for f in fields], F.lit(""))


def first_string(lists: list[Column], keys: list[str]) -> Column:
    """The first text that isn't empty, list by list and key by key."""
    return F.coalesce(*[F.nullif(string_of(a, k), F.lit("")) for a in lists for k in keys])


def as_map(attributes: Column) -> Column:
    """Attributes as a map of text; of repeated keys the last counts."""
    keys = F.transform(attributes, lambda a: a["key"])
    last = F.filter(attributes, lambda a, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), a["key"]))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"].alias("key"), text_of(a["value"]).alias("value")))), F.expr("cast(map() as map<string,string>)"))


def model_parameters(attributes: Column, names: tuple[str, ...], prefix: str, of: Callable[[str], Column] | None = None) -> Column:
    """Numeric request parameters without their prefix; null if there is none. ``of`` gives a name's number, if not the
    list does."""
    of = of or (lambda n: number_of(attributes, n))
    pairs = [F.struct(F.lit(n.removeprefix(prefix)).alias("key"), of(n).cast("string").alias("value")) for n in names]
    return present(F.array(*pairs))


def present(pairs: Column) -> Column:
    """A map of the (key, value) that have a value; null if none has."""
    return let(F.filter(pairs, lambda e: e["value"].isNotNull()), lambda found: F.when(F.size(found) > 0, F.map_from_entries(found)))
