"""Imported snapshots: their identity, staging under a lease, claims and discards."""

import json
from datetime import datetime, timedelta

from spanloom.operators import snapshots as S

T0 = datetime(2024, 5, 1)
RUNS = "project_id string, source string, status string, run_token string, lease_expires_at timestamp"
PULLED = "project_id string, source string, trace_id string, run_token string, ordinal int, content_hash string, tree_hash string, activity_id string, source_activity_at timestamp, snapshot string"


def run(token, minutes=5, status="running"):
    return ("p", "s", status, token, None if minutes is None else T0 + timedelta(minutes=minutes))


def pull(trace, content, tree, activity, minutes=0, token="t1", ordinal=0):
    return ("p", "s", trace, token, ordinal, content, tree, activity, T0 + timedelta(minutes=minutes), "{}")


def staged(spark, state, pulled, runs):
    return [tuple(r) for r in S.stage(spark.createDataFrame(state, S.STATE), spark.createDataFrame(pulled, PULLED), spark.createDataFrame(runs, RUNS), T0).orderBy("trace_id").collect()]


def test_staging_keeps_versions_and_needs_the_lease(spark):
    first = staged(spark, [], [pull("a", "h0", "e0", "x"), pull("a", "h1", "e1", "x1", ordinal=1), pull("b", "h", "e", "y", minutes=2)], [run("t1")])
    assert [(r[2], r[3], r[5], r[9], r[10]) for r in first] == [("a", "h1", "x1", True, True), ("b", "h", "y", True, True)]
    for runs in ([run("t2")], [run("t1", 0)], [run("t1", None)], [run("t1", status="failed")], []):
        assert staged(spark, first, [pull("a", "h2", "e2", "z")], runs) == []
    published = [(*r[:9], False, False, r[11]) for r in first]
    again = staged(spark, published, [pull("a", "h1", "e1", "z", 9, "t2"), pull("b", "h2", "e", "z", 1, "t2")], [run("t2")])
    assert [(r[5], r[6], r[8], r[9], r[10]) for r in again] == [("x1", T0, "t1", False, False), ("z", T0 + timedelta(minutes=2, milliseconds=1), "t2", True, False)]  # scores changed, the tree didn't
    waiting = staged(spark, first, [pull("a", "h1", "e1", "z", 9, "t2")], [run("t2")])[0]
    assert (waiting[5], waiting[8], waiting[9], waiting[10]) == ("x1", "t2", True, True)


def test_claims_discards_and_recovery(spark):
    rows = [tuple(r) for r in staged(spark, [], [pull("a", "h", "e", "x"), pull("b", "h", "e", "y")], [run("t1")])]
    state = spark.createDataFrame([rows[0], (*rows[1][:9], False, True, rows[1][11])], S.STATE)
    runs = lambda *r: spark.createDataFrame(list(r), RUNS)
    assert [(r.trace_id, r.run_token) for r in S.claim_pending(state, runs(run("t2")), T0).collect()] == [("a", "t2")]
    assert S.claim_pending(state, runs(run("t2", 0)), T0).count() == 0
    named = spark.createDataFrame([("p", "s", "a", "x", T0, "t1"), ("p", "s", "b", "y", T0, "t1"), ("p", "s", "a", "other", T0, "t1")], "project_id string, source string, trace_id string, activity_id string, source_activity_at timestamp, run_token string")
    gone, stale = S.discard(state, named, runs(run("t1")), T0)
    assert [(r.trace_id, r.pending, r.snapshot, r.run_token, r.publish_required) for r in gone.collect()] == [("a", False, None, None, False)]
    assert sorted((r.trace_id, r.activity_id) for r in stale.collect()) == [("a", "other"), ("b", "y")]
    gone, stale = S.discard(state, named, runs(run("t2")), T0)
    assert gone.count() == 0 and stale.count() == 3
    for lapsed in (run("t", 0), run("t", None), run("t", status="done")):
        assert [tuple(r) for r in S.recovery_candidates(state, runs(lapsed), T0).collect()] == [("p", "s")]
    assert S.recovery_candidates(state, runs(run("t1")), T0).count() == 0


def test_hashes_tell_contents_apart(spark):
    def hashes(head, parts):
        traces = spark.createDataFrame([("p", "a", head)], "project_id string, trace_id string, body string")
        kids = spark.createDataFrame([("p", "a", k, b) for k, b in parts], "project_id string, trace_id string, kind string, body string")
        return S.content_hashes(traces, kids).select("content_hash", "tree_hash").first()

    head, one, two = json.dumps({"a": 1, "b": {"d": 1, "c": 2}}), ("observation", '{"id":1}'), ("observation", '{"id":2}')
    score = ("score", '{"id":1}')
    base = hashes(head, [one, two])
    assert base == hashes('{"b":{"c":2, "d":1},"a":1}', [two, one])
    others = [hashes("{}", [one, two]), hashes(head, [one]), hashes(head, [one, two, two]), hashes(head, [one, one]), hashes(head, []), hashes(None, []), hashes("x", [])]
    assert len({base.tree_hash, *(o.tree_hash for o in others)}) == len(others) + 1
    scored = hashes(head, [one, two, score])
    assert scored.tree_hash == base.tree_hash and scored.content_hash != base.content_hash
