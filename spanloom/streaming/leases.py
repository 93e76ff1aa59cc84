"""One runner at a time: leases with a token, and progress that only the holder of the token may write.

A runner that was thought dead and wakes up finds another token in its place, so it can't overwrite what its successor
has written. Beside it, the walk over unfinished objects, which a runner does a bounded piece at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.state import LEASE_MINUTES
from spanloom.streaming.ledger import Ledger

LEASES = "project_id string, source string, token string, leased_at timestamp, progress string"


class LeaseLost(RuntimeError):
    """Another runner holds the lease."""


def _mine(project_id: str, source: str):
    return (F.col("project_id") == project_id) & (F.col("source") == source)


def _put(book: Ledger, known: DataFrame, project_id: str, source: str, *rest) -> DataFrame:
    return known.where(~_mine(project_id, source)).unionByName(book.spark.createDataFrame([(project_id, source, *rest)], LEASES))


def claim(book: Ledger, project_id: str, source: str, now: datetime) -> tuple[str, str | None] | None:
    """(token, progress so far), or None while another runner's lease holds."""
    token, found = uuid.uuid4().hex, []

    def change(known: DataFrame) -> DataFrame:
        held = known.where(_mine(project_id, source)).first()
        if held and held.token and held.leased_at >= now - timedelta(minutes=LEASE_MINUTES):
            raise LeaseLost
        found[:] = [held.progress if held else None]
        return _put(book, known, project_id, source, token, now, found[0])

    try:
        book.update(change)
    except LeaseLost:
        return None
    return token, found[0]


def advance(book: Ledger, project_id: str, source: str, token: str, progress: str, now: datetime, release: bool = False) -> None:
    """Writes progress and renews the lease, or gives it back. Raises LeaseLost if the token isn't the current one."""

    def change(known: DataFrame) -> DataFrame:
        held = known.where(_mine(project_id, source)).first()
        if held is None or held.token != token:
            raise LeaseLost(f"{project_id}, {source}")
        return _put(book, known, project_id, source, None if release else token, now, progress)

    book.update(change)


@dataclass(frozen=True)
class Round:
    """A walk over unfinished objects: what was unfinished up to ``mark`` when the round began, after ``after``."""

    mark: datetime
    after: tuple[datetime, str] | None = None


def reconcile(unfinished: DataFrame, done: DataFrame, now: Round | None, limit: int) -> tuple[list, Round | None]:
    """(rows (project_id, object_key, received_at, finished), where to go on) of the next ``limit`` objects of
    ``unfinished`` in order of receipt; ``finished`` says that the object is in ``done``, so that only its mark is
    left to clear. A round ends at the newest object that it found at its start: what comes later waits for the next
    one, so a stream of new objects can't keep a round from its end. None begins a round, and stands for its end."""
    if now is None:
        newest = unfinished.agg(F.max("received_at").alias("mark")).first().mark
        if newest is None:
            return [], None
        now = Round(newest)
    left = unfinished.where(F.col("received_at") <= F.lit(now.mark))
    if now.after:
        left = left.where((F.col("received_at") > F.lit(now.after[0])) | ((F.col("received_at") == F.lit(now.after[0])) & (F.col("object_key") > now.after[1])))
    piece = left.select("project_id", "object_key", "received_at").orderBy("received_at", "object_key").limit(limit + 1)
    known = done.select("project_id", "object_key").distinct().withColumn("finished", F.lit(True))
    rows = piece.join(known, ["project_id", "object_key"], "left").withColumn("finished", F.coalesce("finished", F.lit(False))).orderBy("received_at", "object_key").collect()
    more, rows = len(rows) > limit, rows[:limit]
    return rows, Round(now.mark, (rows[-1].received_at, rows[-1].object_key)) if more else None
