"""Pulled pages as a stream: restarts, fixed windows, and rows of the importers."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources import importers, pulls


def save(path, pages):
    path.mkdir(exist_ok=True)
    for n, ids in enumerate(pages, 1):
        (path / f"page-{n}.json").write_text(json.dumps({"data": [{"id": i, "timestamp": "2024-01-01T00:00:00Z", "tags": ["x"], "name": "é"} for i in ids], "meta": {"totalPages": len(pages)}}))


def test_run_that_dies_goes_on_behind_its_last_page(spark, tmp_path):
    save(tmp_path / "pages", [["a", "b"], ["c"], ["d"], ["e", "f"], ["g"]])
    seen = []

    def write(df, batch):
        rows = [(r.page, json.loads(r.entry)["id"]) for r in df.orderBy("page", "ordinal").collect()]
        if rows and rows[0][0] == 3 and "died" not in seen:
            seen.append("died")
            raise RuntimeError("died")
        seen.extend(rows)

    run = lambda **more: pulls.run_import(spark, write, str(tmp_path / "ck"), path=str(tmp_path / "pages"), **more)
    with pytest.raises(Exception, match="died"):
        run()
    assert seen == [(1, "a"), (1, "b"), (2, "c"), "died"]
    assert pulls.committed_offset(str(tmp_path / "ck"))["page"] == 2
    window = pulls.committed_offset(str(tmp_path / "ck"))["until"]
    run()
    assert [x for x in seen if x != "died"] == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (4, "f"), (5, "g")]
    end = pulls.committed_offset(str(tmp_path / "ck"))
    assert (end["page"], end["until"]) == (5, window)
    assert run() == 0 and len(seen) == 8  # nothing is left


def test_pages_become_traces(spark, tmp_path):
    save(tmp_path / "pages", [["a"], ["b"], ["c"]])
    out = str(tmp_path / "traces")
    row = "id string, timestamp string, name string, userId string, sessionId string, environment string, release string, version string, tags array<string>, metadata string, input string, output string"

    def write(df, batch):
        entries = df.select(F.from_json("entry", row).alias("e")).select("e.*")
        importers.map_list_traces(entries, "p").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    assert pulls.run_import(spark, write, str(tmp_path / "ck"), path=str(tmp_path / "pages"), pagesPerBatch="2") == 2
    got = spark.read.parquet(out)
    assert sorted((r.id, r.name, tuple(r.tags)) for r in got.collect()) == [(i, "é", ("x", "imported:langfuse")) for i in "abc"]
