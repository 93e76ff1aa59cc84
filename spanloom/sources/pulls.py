"""Pulls from another service as a stream: an offset is the last page read of a window that is fixed for the run.

The service counts its pages within the window (since, until), so the window must not move while pages are read: it
is part of every offset. A micro-batch is ``pagesPerBatch`` pages; Spark's checkpoint remembers where the run stands,
and a run that died goes on behind the last page whose micro-batch was committed. Pages are fetched in tasks; the
driver looks at no more than the number of pages that the service names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ENTRY = "page int, ordinal int, entry string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def saved_page(options: dict, page: int) -> dict | None:
    """Page ``page`` of those that a pull has saved under ``path`` as page-<n>.json; None beyond the last."""
    files, path = _opened(f"{options['path'].rstrip('/')}/page-{page}.json")
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def committed_offset(checkpoint: str) -> dict | None:
    """Where a checkpoint stands: the offset of its last committed micro-batch."""
    files, path = _opened(checkpoint)
    numbers = lambda kind: {int(f.base_name) for f in files.get_file_info(fs.FileSelector(f"{path}/{kind}", allow_not_found=True)) if f.base_name.isdigit()}
    done = numbers("commits") & numbers("offsets")
    if not done:
        return None
    with files.open_input_stream(f"{path}/offsets/{max(done)}") as f:
        last = f.read().decode().strip().splitlines()[-1]
    return json.loads(last) if last != "-" else None


class Page(InputPartition):
    def __init__(self, number: int, since: str, until: str):
        self.number, self.since, self.until = number, since, until


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict, fetch: Callable[[dict, int], dict | None]):
        self.options, self.fetch, self.at = options, fetch, None

    def initialOffset(self) -> dict:
        until = self.options.get("until") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return {"page": 0, "since": self.options.get("since", ""), "until": until}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = committed_offset(self.options["checkpoint"]) or self.initialOffset()
        following = self.fetch({**self.options, **self.at}, self.at["page"] + 1)
        if following is not None:
            total = following.get("meta", {}).get("totalPages") or self.at["page"] + 1
            self.at = {**self.at, "page": min(self.at["page"] + int(self.options.get("pagesperbatch", 1)), max(total, self.at["page"] + 1))}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end if self.at is None or end["page"] > self.at["page"] else self.at  # a batch that is run again
        return [Page(n, end["since"], end["until"]) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        got = self.fetch({**self.options, "since": partition.since, "until": partition.until}, partition.number)
        for i, entry in enumerate((got or {}).get("data", [])):
            yield partition.number, i, json.dumps(entry, ensure_ascii=False)


class PulledPages(DataSource):
    """``pulled_pages``. Options (Spark lowers their names): path, checkpoint (the query's own), since, until, pagesPerBatch. A client of a live
    service is a subclass with another ``fetch``."""

    fetch = staticmethod(saved_page)

    @classmethod
    def name(cls) -> str:
        return "pulled_pages"

    def schema(self) -> str:
        return ENTRY

    def streamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options), type(self).fetch)


def run_import(spark: SparkSession, write: Callable[[DataFrame, int], None], checkpoint: str, source: type[DataSource] = PulledPages, **options: str) -> int:
    """Reads what is left of the window and gives each micro-batch (page, ordinal, entry) to ``write``, which is to
    write under the batch's number so that a repeat changes nothing. How many micro-batches were read."""
    spark.dataSource.register(source)
    pages = spark.readStream.format(source.name()).options(checkpoint=checkpoint, **options).load()
    query = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        return sum(1 for p in query.recentProgress if p["numInputRows"])
    finally:
        query.stop()
