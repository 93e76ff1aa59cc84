"""Names, identifiers, levels and JSON text."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Limits and the words that fields may hold.
MOST_ID, MOST_ENVIRONMENT = 512, 64
LEVELS, TYPES, SOURCES = ("debug", "default", "warning", "error"), ("span", "generation", "event"), ("api", "eval", "annotation")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form; Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with the keys of objects in order; null where it isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex signature of a body."""

    @F.pandas_udf(StringType())
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest())

    return sign(body)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def environment(name: Column, composed: bool = True) -> Column:
    """A name in composed form and trimmed; null if it is blank, over long or holds control characters."""
    clean = trimmed(nfc(name) if composed else name)
    ok = (clean != "") & (F.char_length(clean) <= MOST_ENVIRONMENT) & ~clean.rlike(r"[\p{Cc}\p{Cf}]")
    return F.when(ok, clean)


def identifier(text: Column) -> Column:
    """A trimmed id; null if it is empty, too long or holds a zero character."""
    clean = trimmed(text)
    ok = (clean != "") & (F.char_length(clean) <= MOST_ID) & (F.octet_length(clean) <= MOST_ID) & (F.instr(clean, "\0") == 0)
    return F.when(ok, clean)


def one_of(text: Column, words: tuple[str, ...], fallback: str) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*words), low).otherwise(fallback)


def record_id(content: Column) -> Column:
    """The id of a record that came without one, from what it holds."""
    return F.concat(F.lit("lf_"), F.substring(F.sha2(content, 256), 1, 32))


def otlp_trace_id(trace_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("trace:"), trace_id), 256), 1, 32)


def otlp_span_id(observation_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("span:"), observation_id), 256), 1, 16)


def parsed(text: Column) -> Column:
    """VARIANT of JSON text; null where it isn't JSON. JSON's own null isn't SQL's. The parser alone
    would pass over what follows a value; inside brackets nothing may."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.coalesce(F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1, F.lit(False))
    return F.when(alone, F.try_parse_json(text))


def json_map(text: Column) -> Column:
    """An object in JSON text as a map: strings as they are, anything else as JSON text."""
    fields = F.from_json(text, "map<string,variant>", {"mode": "PERMISSIVE"})
    return F.transform_values(fields, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def stringified(values: Column) -> Column:
    """Map values as text, null as the empty text."""
    return F.transform_values(values, lambda _, v: F.coalesce(v.cast("string"), F.lit("")))


def score_type(value: Column, text: Column) -> Column:
    """numeric or categorical; null for a score without a value."""
    return F.when(value.isNotNull(), "numeric").when(text.isNotNull(), "categorical")


def raw_key(project_id: Column, day: Column, batch_id: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), project_id, F.date_format(day, "yyyy/MM/dd"), F.concat(batch_id, F.lit(".json")))


def parse_raw_key(key: Column) -> Column:
    """struct(project_id, day, batch_id); null unless the key is one of ours and names a real day."""
    pattern = r"^raw/([^/]+)/([0-9]{4})/([0-9]{2})/([0-9]{2})/([^/]+)\.json$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    text = F.concat_ws("-", part(2), part(3), part(4))
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(key.rlike(pattern) & (F.date_format(day, "yyyy-MM-dd") == text), F.struct(part(1).alias("project_id"), day.alias("day"), part(5).alias("batch_id")))
