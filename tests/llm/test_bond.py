from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from tillbook.llm import bond, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, w string, number string, block string, windows string, ids string"


def brute(rows):
    """The contract over (vec_id, vector, label), as plain loops; ids are not repeated."""
    known = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        known.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, va, la in known:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in known if i != a and len(v) == len(va))
        for p, pid, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(n, nid) for n, nid, label in scored if label != la and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, pid, rank + 1, nid, -p, -n) for rank, (n, nid) in enumerate(fits)]
    return sorted(out)


def write(spark, rows, folder, parts=3):
    spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(parts).write.parquet(f"{folder}/embeddings.parquet")


def found(spark, folder):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in queries.QUERIES["op11_hard_negatives"](spark, str(folder)).select(columns).collect())


def by_sql(folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return sorted(duck.execute(queries.ORACLE["op11_hard_negatives"]).fetchall())


def vectors(rnd, n, dim=12):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    for i in range(n):
        c = rnd.randrange(4)
        v = [math.floor((x + rnd.gauss(0, 0.6)) * 2**16) / 2**20 for x in centres[c]]
        yield i * 5, v, rnd.choice([c, rnd.randrange(10)])


@pytest.mark.parametrize("sizes", [(4096, 256, 64), (37, 3, 2)])
def test_registered_query(spark, monkeypatch, tmp_path, sizes):
    for name, size in zip(("ROWS_IN_BLOCK", "ANCHORS_IN_CHUNK", "CHUNKS_TOGETHER"), sizes):
        monkeypatch.setattr(bond, name, size)
    rnd = random.Random(1)
    rows = list(vectors(rnd, 400))
    same = [0.25, -0.125] * 6
    rows += [(10_000 + i, same, i % 3) for i in range(300)]  # many equal vectors: ties by id
    rows += [(20_000, None, 1), (20_100, [None] * 12, 1), (20_200, [math.nan] * 12, 1), (20_300, [math.inf] * 12, 2), (20_400, same, None), (None, same, 1)]
    rows += [(20_500, [1.0, 2.0], 1), (20_501, [1.0, 2.0], 1), (20_502, [1.0, 1.7], 2), (20_600, [], 3), (20_601, [], 3), (20_602, [], 4), (-100, same, -3)]
    write(spark, rows, tmp_path)
    want = brute(rows)
    assert found(spark, tmp_path) == want and len(want) > 50
    assert by_sql(tmp_path) == want


def test_every_row_of_a_repeated_id(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bond, "ROWS_IN_BLOCK", 20)
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 100, 3, i]), v, label) for i, v, label in vectors(rnd, 150, 5)]
    write(spark, rows, tmp_path)
    got = found(spark, tmp_path)
    assert got == by_sql(tmp_path) and len(got) > 10


def test_nothing_to_return(spark, tmp_path):
    write(spark, [(100, [1.0], 1), (101, [2.0], 1)], f"{tmp_path}/one")
    write(spark, [(101, [1.0], 1), (102, [2.0], 2)], f"{tmp_path}/two")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/three/embeddings.parquet")
    assert [found(spark, f"{tmp_path}/{x}") for x in ("one", "two", "three")] == [[], [], []]


@pytest.mark.parametrize("size", [1.0, 2.0**30, 2.0**60])
def test_resolve_is_exact_and_prunes(size, monkeypatch):
    rnd = np.random.default_rng(7)
    columns = np.floor(rnd.normal(0, 50, (16, 500))) * size
    block = bond.Block(np.arange(500)[::-1].copy(), rnd.integers(0, 3, 500), columns)
    anchor = np.floor(rnd.normal(0, 50, 16) * np.array([8.0] * 3 + [0.3] * 13)) * size
    exact = [sum(int(a) * int(x) for a, x in zip(anchor, columns[:, i])) for i in range(500)]
    allowed = block.labels != 1
    top = sorted(exact)
    windows = [(top[100], top[300]), (-(1 << 200), 1 << 200), (top[-1] + 1, top[-1] + 2), (top[480], top[480])]
    read = []
    original = bond.np.zeros
    for (lo, hi), (ids, scores) in zip(windows, bond.resolve(block, anchor, allowed, windows, 5)):
        want = sorted((-s, int(block.ids[i])) for i, s in enumerate(exact) if allowed[i] and lo <= s <= hi)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
    monkeypatch.setattr(bond.np, "zeros", lambda n, kind=float: read.append((n, kind)) or original(n, kind))
    bond.resolve(block, anchor, allowed, [windows[0]], 5)
    sizes = [n for n, kind in read if kind is bool]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] / 10
