"""Usage maps: one name for each count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.attributes import let

#: Other names of the canonical keys.
ALIASES = {
    "input": "input_tokens", "output": "output_tokens", "total": "total_tokens", "promptTokens": "input_tokens", "completionTokens": "output_tokens", "totalTokens": "total_tokens",
    "prompt_tokens": "input_tokens", "completion_tokens": "output_tokens",
}


def canonical(usage: Column) -> Column:
    """Aliases renamed. A canonical key that was sent wins; of two aliases the first in the map does."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = F.transform(F.map_entries(usage), lambda e: F.struct(e["key"].alias("sent"), F.coalesce(F.try_element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    own_first = let(named, lambda all_: F.concat(F.filter(all_, lambda e: e["sent"] == e["key"]), F.filter(all_, lambda e: e["sent"] != e["key"])))

    def firsts(all_: Column, keys: Column) -> Column:
        first = F.filter(all_, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    return let(own_first, lambda all_: let(F.transform(all_, lambda e: e["key"]), lambda keys: firsts(all_, keys)))


def token_count(value: Column) -> Column:
    """A count as stored: finite and not negative, halves rounded up; anything else is dropped."""
    number = value.cast("double")
    ok = (number >= 0) & ~F.isnan(number) & (number < F.lit(float("inf")))
    return F.when(ok, F.floor(number + 0.5)).cast("decimal(20,0)")


def counts(usage: Column) -> Column:
    """Sanitised and renamed counts of map<string,double>; null if none is left."""
    clean = F.map_filter(F.transform_values(usage, lambda _, v: token_count(v)), lambda _, v: v.isNotNull())
    return let(clean, lambda c: F.when(F.size(c) > 0, canonical(c)))


def cost_amount(value: Column) -> Column:
    number = value.cast("double")
    ok = (number >= 0) & ~F.isnan(number) & (number < F.lit(float("inf")))
    return F.when(ok, F.expr("1") * value).cast("decimal(18,9)")


def decimal_cost(text: Column) -> Column:
    """A decimal in text; null if it isn't one or is negative."""
    amount = F.expr("cast(null as decimal(18,9))") if text is None else text.try_cast("decimal(18,9)")
    return F.when(amount >= 0, amount)
