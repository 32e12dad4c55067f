from __future__ import annotations

import zlib

import numpy as np

from tillbook.llm import sharding


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_matches_the_published_loop_and_moves_only_to_the_new_shard():
    keys = np.array([*range(2000), 2**63 - 1, -1, -(2**63)])
    now, grown = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert now.tolist() == [jump(int(k) % 2**64, 24) for k in keys]
    moved = now != grown
    assert set(grown[moved]) == {24} and 0.02 < moved.mean() < 0.06


def test_every_row_is_placed_without_gaps(docs_of):
    docs = docs_of((1, "aé"), (1, "aé"), (None, "b"), (2, None), (3, ""), *((i, "x") for i in range(4, 300)), *[(7, "same")] * 200)
    rows = sharding.shard_rows(docs.repartition(5), 7).collect()
    assert len(rows) == 501
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 7) and r.grown_shard == jump(r.doc_id or 0, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1]["size"], by_id[1].text_crc32) == (11, zlib.crc32("aé".encode()))
    assert (by_id[2]["size"], by_id[2].text_crc32, by_id[3]["size"]) == (8, None, 8)


def test_empty_table(docs_of):
    assert sharding.shard_rows(docs_of((1, "a")).limit(0), 3).count() == 0
