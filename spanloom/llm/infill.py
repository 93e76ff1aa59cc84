"""Fill-in-the-middle transformation: texts are cut in three by code points and put in another order.

A text is UTF-8, so the place of its i-th code point has to be counted. While a text is counted, a sparse index
keeps the number and the byte of every ``EVERY``-th code point. A cut is found by binary search in that index and
a rescan of at most ``EVERY`` code points from there, however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import joined_bytes, pieces, table

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of these so many begin with their suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points between two entries of the index; bytes that are counted in one step.
EVERY, STEP_BYTES = 1024, 1 << 20

SHAPE = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


def leads(data: np.ndarray) -> np.ndarray:
    """Places of the bytes that begin a code point."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def index(text: np.ndarray, every: int = EVERY, step: int = STEP_BYTES) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of code points, numbers of the indexed ones, their bytes) of UTF-8 bytes."""
    n, numbers, places = 0, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for start in range(0, len(text), step):
        found = leads(text[start : start + step])
        first = -n % every
        marked = found[first::every]
        numbers.append(n + first + every * np.arange(len(marked), dtype=np.int64))
        places.append(start + marked)
        n += len(found)
    return n, np.concatenate(numbers), np.concatenate(places)


def byte_of(text: np.ndarray, number: int, numbers: np.ndarray, places: np.ndarray, every: int = EVERY) -> int:
    """The byte at which code point ``number`` begins; the end of the text for the one after the last."""
    if not number:
        return 0
    entry = int(np.searchsorted(numbers, number, side="right")) - 1
    at = int(places[entry])
    near = leads(text[at : at + 4 * (every + 1)])  # no code point takes over four bytes
    ahead = number - int(numbers[entry])
    return at + int(near[ahead]) if ahead < len(near) else len(text)


def transformed(text: np.ndarray, h: tuple[int, int, int, int], share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text and its four random numbers."""
    n, numbers, places = index(text)
    raw = text.tobytes()
    if not n or h[2] % 100 >= share or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = byte_of(text, low, numbers, places), byte_of(text, high, numbers, places)
    first, last = (PREFIX.encode(), raw[:a]), (SUFFIX.encode(), raw[b:])
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    parts = (*last, *first) if form == "spm" else (*first, *last)
    return n, form, low, high - low, b"".join((*parts, MIDDLE.encode(), raw[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = 1, share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    Random numbers come from the sha256 of ``seed:doc_id``, so reruns agree, and rows with one id and text come out
    alike; a null id counts as an empty one. A null text is empty. Empty texts and texts that hold a marker stay
    plain, so every output can be taken apart again (``restored``). Repeated rows stay rows of their own, an empty
    table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), digest.alias("digest")).select("doc_id", "text", *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, bounds = joined_bytes(batch.column("text"))
            h = np.stack([batch.column(f"h{i + 1}").to_numpy(zero_copy_only=False) for i in range(4)], axis=1).tolist()
            out = [transformed(data[bounds[i] : bounds[i + 1]], h[i], share, suffix_first) for i in range(batch.num_rows)]
            n, form, prefix, middle, output = zip(*out, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, SHAPE).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with markers are plain, so the markers part the rest uniquely."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
