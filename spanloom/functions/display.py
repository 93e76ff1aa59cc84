"""Numbers, costs, times and payloads as a reader sees them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from spanloom.functions.text import parsed, trimmed

#: Units of compact numbers, what stands where there is no time.
UNITS, NO_TIME = ((1e9, "B"), (1e6, "M"), (1e3, "K")), "\u2014"
#: Roles of messages, most messages, parts and calls that are told apart, layers and length of JSON in strings.
ROLES, MOST_TOLD, LAYERS, MOST_SOURCE = ("system", "developer", "user", "assistant", "tool", "function"), 200, 2, 100_000


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: these texts name it so often that code for them would grow too long."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _rounded(value: Column, digits: int) -> Column:
    """abs(value) in units of 10^-digits: the nearest whole number, the upper one of two. A double's exact value
    decides, not its shortest decimal: it is split in two halves, whose products with a small number are exact."""
    power = float(10**digits)

    def of(size: Column) -> Column:
        lifted = size * F.lit(134217729.0)  # 2^27 + 1
        high = lifted - (lifted - size)
        low = size - high
        reaches = lambda half: ((high * F.lit(2 * power) - half) + low * F.lit(2 * power)) >= 0
        step = lambda near: near + reaches(2.0 * near + 1).cast("long") - (~reaches(2.0 * near - 1)).cast("long")
        return _bound(F.floor(size * F.lit(power) + 0.5), step)

    return _bound(F.abs(value.cast("double")), of)


def fixed(value: Column, digits: int) -> Column:
    """A number below 10^11 with so many decimals; null stays null."""
    sign, power = F.when(value < 0, "-").otherwise(""), 10**digits

    def written(units: Column) -> Column:
        if not digits:
            return F.concat(sign, units.cast("string"))
        return F.concat(sign, F.floor(units / F.lit(power)).cast("string"), F.lit("."), F.lpad((units % power).cast("string"), digits, "0"))

    return _bound(_rounded(value, digits), written)


def compact_number(value: Column) -> Column:
    """Whole numbers below 10,000, else thousands, millions or billions, with a decimal below 100 of them."""
    sign = F.when(value < 0, "-").otherwise("")
    grouped = lambda n: F.concat(sign, F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string")))
    out = F.when(F.abs(value) < 10_000, _bound(_rounded(value, 0), grouped))
    for size, unit in UNITS:
        scaled = value / size
        short = F.when(scaled < 100, F.regexp_replace(fixed(scaled, 1), r"\.0$", "")).otherwise(fixed(scaled, 0))
        out = out.when(F.abs(value) >= size, F.concat(short, F.lit(unit)))
    return out


def usd(value: Column) -> Column:
    """A sum of costs. Below a cent only that much is said."""
    exact = F.concat(F.lit("$"), F.when(value < 1, fixed(value, 4)).otherwise(fixed(value, 2)))
    return F.when(value == 0, "$0.00").when(value < 0.01, "<$0.01").when(value >= 1000, F.concat(F.lit("$"), compact_number(value))).otherwise(exact)


def trace_cost(value: Column) -> Column:
    """One trace's cost, to four decimals below a dollar."""
    return F.when(value == 0, "$0.00").when(value < 0.0001, "<$0.0001").when(value < 1, F.concat(F.lit("$"), fixed(value, 4))).otherwise(usd(value))


def latency(ms: Column) -> Column:
    """Milliseconds, seconds or minutes; a dash where there is no time."""
    seconds = F.when(ms < 10_000, fixed(ms / 1000, 2)).otherwise(fixed(ms / 1000, 1))
    return F.when(ms.isNull(), NO_TIME).when(ms < 1000, F.concat(fixed(ms, 0), F.lit("ms"))).when(ms < 60_000, F.concat(seconds, F.lit("s"))).otherwise(F.concat(fixed(ms / 60_000, 1), F.lit("m")))


def unwrapped(text: Column) -> Column:
    """Text without the JSON string literals around it, two layers at most. What isn't wholly a literal stays."""
    for _ in range(LAYERS):
        literal = trimmed(text)
        length = F.octet_length(F.encode(literal, "UTF-16BE")) / 2
        whole = length.between(2, MOST_SOURCE) & literal.startswith('"') & literal.endswith('"')
        inner = F.when(whole, parsed(literal))
        text = F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(inner, "$", "string")).otherwise(text)
    return text


_CALL = StructType([StructField(n, StringType()) for n in ("id", "name", "arguments")])
_TURN = StructType([
    *[StructField(n, StringType()) for n in ("index", "finish_reason", "role", "name", "content")], StructField("standard", BooleanType()), StructField("tool_call_id", StringType()),
    StructField("tools", ArrayType(_CALL)), StructField("unknown_tools", IntegerType()),
])


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("turns", ArrayType(_TURN))]))
def interpreted(payload: pd.Series) -> pd.DataFrame:
    """(kind, turns) of payloads: ``messages`` or ``choices`` with their turns, ``json`` for anything else. Null stays
    null. Content and arguments are JSON text, arguments that are text stay as they are."""
    told = [(None, None) if p is None else _interpret(p) for p in payload]
    return pd.DataFrame({"kind": pd.Series([k for k, _ in told], dtype=object), "turns": pd.Series([t for _, t in told], dtype=object)})


def _interpret(payload: str) -> tuple[str, list[dict] | None]:
    try:
        value = json.loads(payload, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return "json", None
    if isinstance(value, list):
        turns = _turns(value)
        if turns and all(t["standard"] and isinstance(m.get("finish_reason"), str) for t, m in zip(turns, value, strict=True)):
            return "choices", [{**t, "index": str(i), "finish_reason": _sound(m["finish_reason"])} for i, (t, m) in enumerate(zip(turns, value, strict=True))]
        answers = any(isinstance(m, dict) and isinstance(m.get("parts"), list) and "finish_reason" in m for m in value)
        return ("messages", turns) if turns and not answers else ("json", None)
    if not isinstance(value, dict):
        return "json", None
    if turns := _turns(value.get("messages")):
        return "messages", turns
    choices = value.get("choices")
    if isinstance(choices, list) and all(isinstance(c, dict) for c in choices) and (turns := _turns([c.get("message") for c in choices])):
        return "choices", [{**t, "index": _index(c.get("index")), "finish_reason": _sound(c.get("finish_reason"))} for t, c in zip(turns, choices, strict=True)]
    turns = _turns([value], bounded=False)
    return ("messages", turns) if turns else ("json", None)


def _no_number(name: str) -> None:
    raise ValueError(name)


def _sound(value: object) -> str | None:
    """A string that UTF-8 can hold, halves of pairs replaced; None for anything but strings."""
    return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if isinstance(value, str) else None


def _index(value: object) -> str | None:
    return None if isinstance(value, bool) or not isinstance(value, int | float | str) else _sound(str(value))


def _turns(messages: object, bounded: bool = True) -> list[dict] | None:
    """The turns of a list if all of it are messages, within the bounds on their number, parts and calls."""
    if not isinstance(messages, list) or not 0 < len(messages) <= MOST_TOLD:
        return None
    turns, parts, calls = [], 0, 0
    for m in messages:
        turn = _turn(m)
        if turn is None:
            return None
        listed = next((m[k] for k in ("content", "parts") if isinstance(m.get(k), list)), ())
        parts, calls = parts + len(listed), calls + len(_list(m.get("tool_calls")))
        turns.append(turn)
    return None if bounded and max(parts, calls) > MOST_TOLD else turns


def _list(value: object) -> list:
    return value if isinstance(value, list) else []


def _turn(m: object) -> dict | None:
    """A message as a turn; None if it is none. Parts of the standard form exclude content."""
    if not isinstance(m, dict) or not isinstance(m.get("role"), str) or not m["role"]:
        return None
    content, tools, standard = m.get("content"), _list(m.get("tool_calls")), "parts" in m
    if max(len(_list(content)), len(tools)) > MOST_TOLD:
        return None
    if standard:
        parts = m["parts"]
        if content is not None or not isinstance(parts, list) or len(parts) > MOST_TOLD or not all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in parts):
            return None
        content, tools = parts, []
    elif m["role"] not in ROLES or (content is None and not tools):
        return None
    named = [c for c in map(_call, tools) if c]
    return {
        "index": None, "finish_reason": None, "role": _sound(m["role"]), "name": _sound(m.get("name")), "content": None if content is None else json.dumps(content), "standard": standard,
        "tool_call_id": None if standard else _sound(m.get("tool_call_id")), "tools": named, "unknown_tools": len(tools) - len(named),
    }


def _call(call: object) -> dict | None:
    if not isinstance(call, dict):
        return None
    inner = call["function"] if isinstance(call.get("function"), dict) else None
    name = next((d["name"] for d in (inner or {}, call) if isinstance(d.get("name"), str)), None)
    if not name:
        return None
    given = inner.get("arguments") if inner is not None else call.get("arguments", call.get("args"))
    return {"id": _sound(call.get("id")), "name": _sound(name), "arguments": _sound(given) if isinstance(given, str) else None if given is None else json.dumps(given)}
