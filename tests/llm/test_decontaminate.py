from __future__ import annotations

import re

import pytest

from tillbook.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(size, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(own) - k + 1 if k else 0):
            if tuple(own[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(own), len(hit), found


@pytest.mark.parametrize("limit", [200_000, 3])
def test_matches_brute_force(spark, docs_of, prose, monkeypatch, limit):
    """The second run meets the benchmark by a shuffled join."""
    monkeypatch.setattr(decontaminate, "SET_WINDOWS", limit)
    items = [(i, prose(100 + i, 25)) for i in range(6)] + [(6, "short Item é"), (7, "short Item é"), (8, None), (9, " . "), (None, "null item of some words here"), (3, prose(103, 25))]
    text = prose(1, 40)
    passage = items[0][1].split()
    rows = [
        (1, text), (2, f"{text} {items[0][1].upper()}, {text}"), (3, " ".join(passage[:9])), (4, " ".join(passage[3:14])), (5, None), (6, ""),
        (7, "SHORT,item-é " * 3), (8, f"{items[1][1]} x {items[2][1]}"), (8, "again short item é"), (9, "É short ITEM É"), (10, "short item e"),
    ]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, gram string")
    keys = {r[1]: brute(r[1], [(i, t) for i, t in items if i is not None]) for r in rows}
    found = decontaminate.find(docs_of(*rows), benchmark, keep=["doc_id", "text"])
    got = found.select("text", "n_words", decontaminate.covered("spans").alias("n"), "items").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n, set(r["items"])) == keys[r.text], r.text
    clean = decontaminate.clean(docs_of(*rows), benchmark)
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for _, t in rows if not keys[t][1])


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of((1, "a b c"), (2, None))
    assert [r.n_words for r in decontaminate.find(docs, none, keep=["doc_id"]).orderBy("doc_id").collect()] == [3, 0]
    assert decontaminate.clean(docs, none).count() == 2 and decontaminate.find(docs.limit(0), none, keep=["doc_id"]).count() == 0
