from __future__ import annotations

import math
import random

import pytest

from tillbook.llm import queries, topk


def brute(rows, k, scale=64):
    known = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(scale * x) for x in v]
        known[i] = min(v, known[i]) if i in known else v
    out = []
    for q in known:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q and len(v) == len(known[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    return sorted(tuple(r) for r in topk.top_k(df, lambda id: id % 20 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("blocks", [(4096, 512), (37, 3)])
def test_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "ROWS_IN_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", blocks[1])
    rnd = random.Random(1)
    same = [0.5, -0.25, 0.125, 1.0, 0.0]
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(200)] + [(i, same) for i in range(200, 320)]
    rows = [(i, [math.floor(x * 2**20) / 2**20 for x in v]) for i, v in rows]  # as floats have them
    rows += [(400, None), (420, [None] * 5), (401, [math.nan] * 5), (402, [math.inf] * 5), (None, same), (5, same), (5, same), (440, [1.0, 2.0])]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, -1.0]), (1, [-3.0, 2.0]), (2, [-9.0, 5.0])]
    assert found(spark, rows, 20) == brute(rows, 20) == [(0, 1, 1, -20480), (0, 2, 2, -57344)]
    assert found(spark, [(1, [1.0])], 20) == [] and found(spark, [(20, [1.0])], 20) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**22, 3.0]), (1, [2.0**22, 1.0]), (2, [2.0**22, 2.0])]
    assert found(spark, rows, 2) == brute(rows, 2)


@pytest.mark.parametrize("blocks", [(4096, 512), (37, 3)])
def test_query_takes_every_row_of_a_repeated_id(spark, monkeypatch, tmp_path, blocks):
    import duckdb

    monkeypatch.setattr(topk, "ROWS_IN_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", blocks[1])
    rnd = random.Random(2)
    rows = [(rnd.choice([7, 20, i]), [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(150)]
    rows += [(40, [1.0] * 4), (40, [1.0] * 4), (41, [1.0] * 4), (41, [1.0] * 4), (41, [1.0] * 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(queries.ORACLE["op2_exact_topk"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["op2_exact_topk"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in want if r[0] == 20}) < 20


def test_every_row_of_an_id_with_vectors_of_two_lengths(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0, 1.0]), (1, [2.0]), (2, [1.0, 2.0]), (3, [4.0])], "vec_id long, embedding array<float>")
    out = topk.top_k(df, lambda id: id % 20 == 0, 2, every_row=True).collect()
    assert sorted(tuple(r) for r in out) == [(0, 1, 3, 16384), (0, 2, 2, 12288)]


def test_blocks_out_of_reach_are_left_out(spark, monkeypatch):
    """Only blocks whose bound reaches a cutoff meet the queries, and the rows are the same."""
    monkeypatch.setattr(topk, "ROWS_IN_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 8)
    monkeypatch.setattr(topk, "LEADERS", 6)
    met, real = [], topk._reachable

    def reachable(queries, rows, n_row):
        pairs = real(queries, rows, n_row)
        met.append((pairs.count(), queries.select("_qb").distinct().count() * n_row))
        return pairs

    monkeypatch.setattr(topk, "_reachable", reachable)
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        size = 10.0 if i < 60 else 0.5
        rows.append((i, [math.floor(size * rnd.uniform(0.5, 1) * 2**16) / 2**16 for _ in range(6)]))
    assert found(spark, rows, 5) == brute(rows, 5)
    assert met[0][0] < met[0][1] / 2


def test_negative_cutoffs_and_zero_vectors_keep_every_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_IN_BLOCK", 10)
    monkeypatch.setattr(topk, "LEADERS", 2)
    rows = [(i, [0.0, 0.0, 0.0]) for i in range(0, 40, 2)] + [(i, [-1.0 * (i % 5), 0.5, 1.0]) for i in range(1, 60, 2)]
    rows += [(60, [3.0, -2.0, -1.0]), (80, [0.0, 0.0, 0.0])]
    assert found(spark, rows, 7) == brute(rows, 7)
