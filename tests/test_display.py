"""What readers see: numbers against exact decimals, payloads case by case."""

import json
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from spanloom.functions import display


def exact(value, digits):
    with localcontext(prec=400):
        return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def test_decimals_follow_the_exact_value(spark):
    rng = random.Random(3)
    near = [m / 10**d + s for d in (1, 2, 3, 5) for m in (5, 15, 25, 125, 1005, 99_995) for s in (0.0, 1e-12, -1e-12)]
    values = [0.0, 1.005, 2.675, 0.25, 0.75, 0.125, 8.5, 1.45, 0.00005, 99.95, 123_456_789.125, *near, *(rng.uniform(0, 10.0 ** rng.randint(-4, 9)) for _ in range(3000))]
    values = [v for v in values if v >= 0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[display.fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 4)]).collect()
    for r in got:
        assert tuple(r[1:]) == tuple(exact(r.v, d) for d in (0, 1, 2, 4)), r


def test_numbers_costs_and_times(spark):
    def told(function, cases):
        df = spark.createDataFrame([(k, w) for k, w in cases], "v double, want string").withColumn("got", function(F.col("v")))
        assert [(r.v, r.got) for r in df.collect()] == [(r.v, r.want) for r in df.collect()]

    told(display.compact_number, [(0.0, "0"), (999.4, "999"), (1284.0, "1,284"), (9999.6, "10,000"), (10_000.0, "10K"), (12_940.0, "12.9K"), (128_400.0, "128K"), (4_200_000.0, "4.2M"), (1.1e9, "1.1B"), (-12_940.0, "-12.9K"), (-5.0, "-5"), (None, None)])
    told(display.usd, [(0.0, "$0.00"), (0.004, "<$0.01"), (0.25, "$0.2500"), (12.345, "$12.35"), (1284.0, "$1,284"), (12_840.0, "$12.8K"), (None, None)])
    told(display.trace_cost, [(0.0, "$0.00"), (0.00001, "<$0.0001"), (0.0042, "$0.0042"), (3.5, "$3.50")])
    told(display.latency, [(None, "\u2014"), (12.5, "13ms"), (1500.0, "1.50s"), (12_340.0, "12.3s"), (120_000.0, "2.0m")])


def kinds(spark, values):
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return [r.p for r in spark.createDataFrame(rows, "i int, t string").select("i", display.interpreted("t").alias("p")).orderBy("i").collect()]


def test_payload_kinds(spark):
    user, parts = {"role": "user", "content": "x"}, {"role": "model", "parts": [{"type": "text"}]}
    done = {**parts, "finish_reason": "stop"}
    cases = [
        ([user, user], "messages"), ({"messages": [user]}, "messages"), (user, "messages"), ([parts], "messages"), ([done, done], "choices"), ([done, parts], "json"), ([{**done, "finish_reason": None}], "json"),
        ({"choices": [{"index": 0, "message": user}]}, "choices"), ({"choices": [{"message": {"role": "user"}}]}, "json"), ([{"role": "user"}], "json"), ([{"role": "other", "content": "x"}], "json"), ([{**parts, "content": "x"}], "json"),
        ([{"role": "assistant", "content": None, "tool_calls": [{}]}], "messages"), ([user] * 200, "messages"), ([user] * 201, "json"), ([{"role": "user", "content": [1] * 150}] * 2, "json"), ([], "json"), ("no json", "json"), ("NaN", "json"), ('"x"', "json"), ("", "json"),
        ("[" * 100_000, "json"), ({"messages": [], **user}, "messages"), ([{"role": "user", "parts": []}], "messages"), (None, None),
    ]
    assert [p.kind if p else None for p in kinds(spark, [c for c, _ in cases])] == [k for _, k in cases]


def test_payload_turns(spark):
    tools = [{"id": "1", "function": {"name": "f", "arguments": '{"n": 12345678901234567890}'}}, {"name": "g", "args": {"a": 1}}, {"function": {}}, 5]
    got = kinds(spark, [{"choices": [{"index": 2, "finish_reason": "stop", "message": {"role": "assistant", "content": "\ud800x", "name": "n\ud800", "tool_calls": tools}}]}])[0]
    turn = got.turns[0]
    assert (got.kind, turn["index"], turn.finish_reason, turn.role, turn.name, turn.unknown_tools) == ("choices", "2", "stop", "assistant", "n\ufffd", 2)
    assert [(c.id, c.name, c.arguments) for c in turn.tools] == [("1", "f", '{"n": 12345678901234567890}'), (None, "g", '{"a": 1}')]


def test_literals_are_taken_out(spark):
    once, twice, long = json.dumps({"a": 1}), json.dumps(json.dumps({"a": 1})), json.dumps("x" * 100_000)
    cases = [(twice, once), (json.dumps(twice), once), (json.dumps(json.dumps(twice)), twice), ('"plain"', "plain"), (' "x" ', "x"), ('"', '"'), ('"a" b"', '"a" b"'), ("C:\\new", "C:\\new"), (long, long), ("", ""), (None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", display.unwrapped(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in rows] == [w for _, w in cases]
