"""Operators that depend on order, against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillbook.operators import admission
from tillbook.operators.admission import admit_in_order, admit_whole, admit_with_inflows
from tillbook.operators.cooldown import accepted_requests
from tillbook.operators.running import Running, position, running_all


def hot_rows(seed: int, n: int, keys: int):
    """A third of the rows belong to one key."""
    rnd = random.Random(seed)
    return [(i, 0 if rnd.random() < 0.34 else rnd.randrange(keys), rnd.randrange(400)) for i in range(n)], rnd


def test_running_matches_a_loop(spark):
    rows, rnd = hot_rows(1, 600, 8)
    data = [(i, k, t, rnd.randrange(-5, 9)) for i, k, t in rows]
    df = spark.createDataFrame(data, "id long, k long, t long, v long")
    cols = [
        Running("total", F.col("v")),
        Running("before", F.col("v"), inclusive=False),
        Running("high", F.col("v"), "max"),
        Running("low_before", F.col("v"), "min", False),
    ]
    got = {r.id: (r.total, r.before, r.high, r.low_before)
           for r in running_all(df, ["k"], ["t", "id"], cols, F.floor(F.col("t") / 50)).collect()}
    want, state = {}, {}
    for i, k, t, v in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        seen = state.setdefault(k, [])
        want[i] = (sum(seen) + v, sum(seen), max([*seen, v]), min(seen) if seen else None)
        seen.append(v)
    assert got == want


def test_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, None, 1, 5), (2, None, 2, 6), (3, 7, 1, 8), (4, None, 11, 9)], "id long, k long, t long, v long")
    args = (df, ["k"], ["t"], [Running("total", F.col("v"))], F.floor(F.col("t") / 10))
    assert {r.id: r.total for r in running_all(*args).collect()} == {1: 5, 2: 11, 3: 8, 4: 9}
    assert {r.id: r.total for r in running_all(*args, null_keys=False).collect()} == {3: 8}


def test_positions_over_the_whole_table(spark):
    df = spark.range(500).selectExpr("id * 3 as id")
    got = {r.id: r.n for r in position(df, [], ["id"], "n", F.floor(F.col("id") / 100)).collect()}
    assert got == {3 * i: i + 1 for i in range(500)}


@pytest.mark.parametrize("seed", [3, 4])
def test_admission_matches_a_loop(spark, seed):
    rows, rnd = hot_rows(seed, 700, 12)
    data = [(i, k, t, rnd.choice([0, 1, 1, 2, 3, 7, 20, 64])) for i, k, t in rows]
    room = [(k, rnd.choice([0, 1, 5, 40, 300])) for k in range(11)]  # key 11 has no capacity row
    requests = spark.createDataFrame(data, "id long, k long, t long, q long")
    capacity = spark.createDataFrame(room, "k long, capacity long")
    out = admit_in_order(requests, capacity, "k", ["t", "id"], "q", F.floor(F.col("t") / 100))
    got = {r.id: r.admitted for r in out.collect()}
    left, want = dict(room), {}
    for i, k, t, q in sorted(data, key=lambda r: (r[2], r[0])):
        want[i] = 0 < q <= left.get(k, 0)
        if want[i]:
            left[k] -= q
    assert got == want and out.columns == ["id", "k", "t", "q", "admitted"]


@pytest.mark.parametrize("seed", [5, 7])
def test_admission_with_inflows_matches_a_loop(spark, seed):
    """One key has most of the events; some open below zero."""
    rows, rnd = hot_rows(seed, 60, 6)
    data = [(i, k, t, rnd.choice([5, 3, 0, -2, -4, -9, -30])) for i, k, t in rows]
    opening = [(k, rnd.choice([-5, 0, 10])) for k in range(6)]
    out = admit_with_inflows(
        spark.createDataFrame(data, "id long, k long, t long, d long"),
        spark.createDataFrame(opening, "k long, opening long"),
        "k", ["t", "id"], "d", F.floor(F.col("t") / 80),
    )
    got = {r.id: r.admitted for r in out.collect()}
    till, want = dict(opening), {}
    for i, k, t, d in sorted(data, key=lambda r: (r[2], r[0])):
        want[i] = till[k] + d >= 0 if d < 0 else True
        if want[i]:
            till[k] += d
    assert got == want


def serve(lines, stock):
    """Whole requests one after the other, as a plain loop: lines (request, time, key, delta)."""
    left, requests, out = dict(stock), {}, {}
    for r, t, k, d in lines:
        requests.setdefault((t, r), []).append((k, d))
    for (_, r), own in sorted(requests.items()):
        out[r] = all(d >= 0 or -d <= left.get(k, 0) for k, d in own)
        if out[r]:
            for k, d in own:
                left[k] = left.get(k, 0) + d
    return out


@pytest.mark.parametrize(("seed", "batch", "requests"), [(11, 20_000, 250), (12, 60, 250), (13, 0, 30)])
def test_whole_requests_match_a_loop(spark, monkeypatch, seed, batch, requests):
    """Requests over several keys, a key in a third of the lines, keys twice in a request, fills between, unknown keys."""
    monkeypatch.setattr(admission, "ROWS_OF_ALL", batch)
    rnd, lines = random.Random(seed), []
    for r in range(requests):
        t, fills = rnd.randrange(60), rnd.random() < 0.15
        for _ in range(rnd.choice([1, 1, 2, 3, 5])):
            k = 0 if rnd.random() < 0.34 else rnd.randrange(14)
            lines.append((r, t, k, rnd.randrange(4) if fills else -rnd.choice([1, 1, 2, 3, 9])))
    stock = [(k, rnd.choice([0, 2, 6, 25])) for k in range(13)]
    out = admit_whole(
        spark.createDataFrame(lines, "r long, t long, k long, d long"), spark.createDataFrame(stock, "k long, opening long"),
        "r", "k", ["t", "r"], "d", F.floor(F.col("t") / 20))
    got = {x.r: x.admitted for x in out.collect()}
    want = serve(lines, stock)
    assert got == want and out.count() == len(want) and 0 < sum(want.values()) < requests


def test_nothing_to_serve(spark):
    none = spark.createDataFrame([], "r long, t long, k long, d long")
    assert admit_whole(none, spark.createDataFrame([(1, 2)], "k long, opening long"), "r", "k", ["t", "r"], "d", F.col("t")).collect() == []


def test_a_long_till_takes_few_rounds(spark, monkeypatch):
    """100,000 doubtful cash-outs and payments of one key: rounds by batches, not by events."""
    rounds = []
    real = admission.cut_lineage
    monkeypatch.setattr(admission, "cut_lineage", lambda df: rounds.append(1) or real(df))
    events = spark.range(100_000).select(
        F.lit(1).alias("k"), F.col("id").alias("t"),
        F.when(F.col("id") % 3 == 0, 5 + F.col("id") % 11).otherwise(-(F.col("id") * 7919 % 23) - 1).alias("d"))
    opening = spark.createDataFrame([(1, 0)], "k int, opening long")
    got = {r.t: r.admitted for r in admit_with_inflows(events, opening, "k", ["t"], "d", F.floor(F.col("t") / 5000)).collect()}
    till, want = 0, {}
    for i in range(100_000):
        d = 5 + i % 11 if i % 3 == 0 else -(i * 7919 % 23) - 1
        want[i] = till + d >= 0
        till += d if want[i] else 0
    assert got == want and 0 < sum(not x for x in want.values()) and len(rounds) <= 10


def test_cooldown_matches_a_loop(spark):
    start = datetime(2024, 1, 1, 23, 58)
    rows, rnd = hot_rows(6, 500, 5)
    data = [(i, k, start + timedelta(seconds=t * 2.7 + rnd.random())) for i, k, t in rows]
    df = spark.createDataFrame(data, "id long, k long, ts timestamp_ntz")
    got = {(r.k, r.id) for r in accepted_requests(df, ["k"], "ts", "id", seconds=60).collect()}
    last, want = {}, set()
    for i, k, ts in sorted(data, key=lambda r: (r[2], r[0])):
        if k not in last or (ts - last[k]).total_seconds() >= 60:
            want.add((k, i))
            last[k] = ts.replace(microsecond=0)
    assert got == want


def test_requests_in_turn_beside_a_long_key(spark, monkeypatch):
    """Repeated requests count once, null keys and stocks refuse, columns of any kind go along; a long key goes in rounds."""
    monkeypatch.setattr(admission, "ROWS_OF_KEY", 40)
    rnd = random.Random(9)
    data = [(i, 0 if i % 3 == 0 else i % 7, rnd.randrange(90), rnd.choice([0, 1, 2, 5, None]), ["x"]) for i in range(200)]
    data += [*[r for r in data[:30] if r[1]], (900, None, 1, 1, []), (901, 8, 1, 1, None)]
    room = [(k, 9 * k + 6) for k in range(8)] + [(k, 9 * k + 6) for k in range(1, 8)] + [(8, None), (None, 50), (2**40, 5)]
    requests = spark.createDataFrame(data, "id long, k int, t long, q long, names array<string>")
    out = admit_in_order(requests, spark.createDataFrame(room, "k long, capacity long"), "k", ["t", "id"], "q", F.floor(F.col("t") / 30))
    left, want = dict(room), {}
    for i, k, t, q, _ in sorted({(*r[:4], None) for r in data}, key=lambda r: (r[2], r[0])):
        want[i] = k is not None and q is not None and left.get(k) is not None and 0 < q <= left[k]
        if want[i]:
            left[k] -= q
    rows = out.collect()
    assert {r.id: r.admitted for r in rows} == want and sorted(r.id for r in rows) == sorted(r[0] for r in data)
    assert out.columns == [*requests.columns, "admitted"] and out.schema["k"].dataType == requests.schema["k"].dataType


def test_short_keys_are_not_joined_with_their_decisions(spark):
    """The requests are shuffled whole once; their decisions come in the same pass."""
    requests = spark.range(100).select("id", (F.col("id") % 9).alias("k"), F.lit(2).alias("q"))
    out = admit_in_order(requests, spark.range(9).select(F.col("id").alias("k"), F.lit(5).alias("capacity")), "k", ["id"], "q", F.lit(0))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.where("admitted").count() == 18


def test_whole_requests_beside_a_long_key(spark, monkeypatch):
    """Keys of many rows are walked by spans, others in one piece; each round writes one row per request."""
    monkeypatch.setattr(admission, "ROWS_OF_KEY", 30)
    monkeypatch.setattr(admission, "ROWS_OF_ALL", 25)
    written, real = [], admission.cut_lineage
    monkeypatch.setattr(admission, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    rnd, lines = random.Random(21), []
    for r in range(150):
        lines += [(r, r % 50, 0 if rnd.random() < 0.3 else rnd.randrange(12), -rnd.choice([1, 2, 4])) for _ in range(rnd.choice([1, 2, 4]))]
    stock = [(k, rnd.choice([3, 8, 30])) for k in range(12)]
    out = admit_whole(
        spark.createDataFrame(lines, "r long, t long, k long, d int"), spark.createDataFrame(stock, "k long, opening int"),
        "r", "k", ["t", "r"], "d", F.floor(F.col("t") / 20))
    assert {x.r: x.admitted for x in out.collect()} == serve(lines, stock) and ["r", "admitted"] in written
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") <= 4 and "Join" not in plan


def test_running_in_one_piece(spark):
    df = spark.createDataFrame([(1, 7, 1, 5), (2, 7, 2, 6), (3, 7, 3, None), (4, None, 1, 9)], "id long, k long, t long, v long")
    cols = [Running("total", F.col("v")), Running("before", F.col("v"), inclusive=False), Running("high", F.col("v"), "max", False)]
    got = {r.id: (r.total, r.before, r.high) for r in running_all(df, ["k"], ["t"], cols, null_keys=False).collect()}
    assert got == {1: (5, 0, None), 2: (11, 5, 5), 3: (11, 11, 6)}
