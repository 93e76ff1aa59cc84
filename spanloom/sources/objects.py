"""Raw objects in the order of their keys: by prefix, after a key, a page at a time.

Folders are opened as the walk comes to them, and only those that can hold a wanted key: neither one outside the
prefix nor one whose keys all come before the place where the last page ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.raw import read_batches
from spanloom.streaming.ledger import Files

OBJECT = "object_key string, size bigint"


def walk(files: Files, root: str, prefix: str = "", start_after: str = "", folder: str = "") -> Iterator[tuple[str, int]]:
    """(key, bytes) of the objects below ``root`` whose key has the prefix and comes after ``start_after``."""
    found = [(f"{folder}{name}/" if inner else f"{folder}{name}", inner, size) for name, inner, size in files.listed(f"{root}/{folder}")]
    for key, inner, size in sorted(found):
        if inner:
            before = key <= start_after and not start_after.startswith(key)  # then all keys below come before it too
            if not before and (key.startswith(prefix) or prefix.startswith(key)):
                yield from walk(files, root, prefix, start_after, key)
        elif key.startswith(prefix) and key > start_after:
            yield key, size


@dataclass
class ObjectPage:
    """Objects of a page, the key to go on after, and what ended the page: objects, bytes, response, or None."""

    objects: list[tuple[str, int]]
    last: str
    cut: str | None


def page(files: Files, root: str, prefix: str = "", start_after: str = "", most_objects: int = 1000, most_bytes: int = 64 << 20, most_response: int = 1 << 20) -> ObjectPage:
    """The next objects while their number, their bytes and the bytes of the answer (a key and its size a line) keep
    the caps. The first object is given whatever its size, so that a walk always gets on."""
    taken, size, answer = [], 0, 0
    for key, length in walk(files, root, prefix, start_after):
        line = len(key.encode()) + len(str(length)) + 2
        over = "objects" if len(taken) == most_objects else "bytes" if size + length > most_bytes else "response" if answer + line > most_response else None
        if over and taken:
            return ObjectPage(taken, taken[-1][0], over)
        taken.append((key, length))
        size, answer = size + length, answer + line
    return ObjectPage(taken, taken[-1][0] if taken else start_after, None)


def listed(spark: SparkSession, found: ObjectPage) -> DataFrame:
    return spark.createDataFrame(found.objects, OBJECT)


def batches_of(spark: SparkSession, root: str, found: ObjectPage) -> DataFrame:
    """The batches that the page's objects hold."""
    return read_batches(spark, [f"{root}/{key}" for key, _ in found.objects])
