"""Leases with tokens, and rounds over unfinished objects."""

from datetime import datetime, timedelta

import pytest

from spanloom.streaming import leases
from spanloom.streaming.ledger import Ledger

T0 = datetime(2024, 5, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_a_lease_and_its_token(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "leases"), leases.LEASES)
    token, before = leases.claim(book, "p", "s", at(0))
    assert before is None and leases.claim(book, "p", "s", at(4)) is None and leases.claim(book, "p", "other", at(4)) is not None
    leases.advance(book, "p", "s", token, "page 2", at(4))
    assert leases.claim(book, "p", "s", at(8)) is None  # renewed
    second, before = leases.claim(book, "p", "s", at(10))
    assert before == "page 2"
    with pytest.raises(leases.LeaseLost):
        leases.advance(book, "p", "s", token, "page 9", at(10))  # the first runner wakes up
    leases.advance(book, "p", "s", second, "page 3", at(11), release=True)
    third = leases.claim(book, "p", "s", at(11))
    assert third is not None and third[1] == "page 3"


def test_rounds_end_though_more_comes_in(spark):
    shape = "project_id string, object_key string, received_at timestamp"
    rows = [("p", f"k{i}", at(i // 2)) for i in range(5)]
    table = lambda given: spark.createDataFrame(given, shape)
    done = table([("p", "k1", at(0))])
    seen, where = [], None
    for _ in range(5):
        got, where = leases.reconcile(table(rows), done, where, 2)
        seen += [(r.object_key, r.finished) for r in got]
        rows.append(("p", f"late{len(rows)}", at(10 + len(rows))))
        if where is None:
            break
    assert seen == [("k0", False), ("k1", True), ("k2", False), ("k3", False), ("k4", False)] and where is None
    assert [r.object_key for r in leases.reconcile(table(rows[5:]), done, None, 9)[0]] == ["late5", "late6", "late7"]
    assert leases.reconcile(table([]), done, None, 2) == ([], None)
