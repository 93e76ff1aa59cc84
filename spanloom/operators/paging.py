"""Pages: by key (no offset to skip), by offset with a total, and the cursors between them."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, keys: list[str], limit: int, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """``limit + 1`` rows after the cursor: the last one only says that there are more."""
    if after is not None:
        at, cursor = F.struct(*keys), F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.where(at < cursor if descending else at > cursor)
    return df.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys]).limit(limit + 1)


def held(page: DataFrame) -> tuple[DataFrame, list]:
    """A page, held by the driver (it has ``limit + 1`` rows at most), so that what is looked up for it
    needn't find it again."""
    rows = page.collect()
    return page.sparkSession.createDataFrame(rows, page.schema), rows


def of_page(children: DataFrame, rows: list) -> DataFrame:
    """All versions of the children of a page's traces. The ids are literals: they reach the scan."""
    return children.where(F.col("project_id").isin(sorted({r.project_id for r in rows})) & F.col("trace_id").isin(sorted({r.id for r in rows})))


def cut_page(rows: list, limit: int) -> tuple[list, bool]:
    return rows[:limit], len(rows) > limit


def offset_page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_total(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / limit).cast("long"))


def encode_cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str, fields: tuple[str, ...]) -> dict | None:
    """None if the text isn't a cursor with exactly these fields."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        return None
    return found if isinstance(found, dict) and sorted(found) == sorted(fields) and all(isinstance(v, str) for v in found.values()) else None
