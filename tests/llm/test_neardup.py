from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tillbook.llm import components, neardup


def shingles(text, size=5):
    words = text.split()
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else Counter([tuple(words)] if words else [])


def similarity(a, b):
    union = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in union) for i in set(a) & set(b))


def brute(rows, least=0.8):
    texts = [t or "" for _, t in rows]
    bags = [shingles(t) for t in texts]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or similarity(bags[i], bags[j]) >= least:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows(prose):
    rnd = random.Random(9)
    out = []
    for i in range(25):
        words = prose(i, rnd.choice([7, 40, 150, 400])).split()
        out.append(" ".join(words))
        for _ in range(rnd.randrange(5)):
            copy = list(words)
            for _ in range(rnd.randrange(1, 2 + len(words) // 25)):
                copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(10**6)}"
            out.append(" ".join(copy))
    line = prose(77, 30)
    out += [f"{line} {prose(500 + i, 10)}" for i in range(12)]  # alike, but under the threshold
    out += [out[0], out[0], "", None, "a b", "a b", "a c", " ", "k " * 3000, "k " * 2000, (line + " ") * 40]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [512, 4])
def test_classes_match_brute_force(docs_of, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    want = brute(rows)
    smallest = {}
    for (i, _), c in zip(rows, want):
        smallest.setdefault(c, i)
    got = {r.doc_id: r for r in neardup.class_of_each(docs_of(*rows)).collect()}
    assert {i: got[i].class_id for i, _ in rows} == {i: smallest[c] for (i, _), c in zip(rows, want)}
    assert {i for i, r in got.items() if r.kept} == set(smallest.values())
    assert all(r.class_size == want.count(want[i]) for i, r in got.items())


def test_one_of_each_class_stays_whole(docs_of, prose):
    text = prose(3, 60)
    near = text.replace(text.split()[10], "changed", 1)
    docs = docs_of((7, text), (3, near), (7, text), (None, text), (None, None), (9, ""), (5, prose(4, 50)))
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(r.doc_id for r in kept) == [3, 5, 9] and all(r["node"] == "x" for r in kept)
    each = neardup.class_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in each) == [(0, 3), (0, 9), (3, 3), (5, 5), (7, 3), (7, 3), (9, 9)]
    assert sum(r.kept for r in each) == 3
    assert neardup.keep_one(docs.limit(0)).count() == 0 and neardup.class_of_each(docs.limit(0)).count() == 0


def test_registers_estimate_the_similarity_of_weighted_sets():
    rnd = random.Random(4)
    estimates = []
    for _ in range(40):
        a = {rnd.getrandbits(63): rnd.randrange(1, 9) for _ in range(60)}
        b = {k: max(1, v + rnd.randrange(-2, 3)) for k, v in a.items() if rnd.random() < 0.8} | {rnd.getrandbits(63): 3 for _ in range(8)}
        sides = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)], np.float64)) for s in (a, b)]
        text = np.repeat([0, 1], [len(a), len(b)])
        registers = neardup.signatures(text, np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]), 2)
        exact = similarity(Counter(a), Counter(b))
        assert abs(neardup.probability_jaccard(*sides[0], *sides[1]) - exact) < 1e-9
        estimates.append((registers[0] == registers[1]).mean() - exact)
    assert abs(np.mean(estimates)) < 0.02 and np.std(estimates) < 0.06


def test_shingles_of_short_texts():
    text, _, count = neardup.weighted_shingles(pa.array(["a b", None, "", "a a a a a a", "x y z u v"]), 5)
    assert text.tolist() == [0, 3, 4] and count.tolist() == [1, 2, 1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_words_that_sums_cannot_tell_apart(docs_of):
    """A Thue-Morse string of 1,024 bytes and its complement are equal in any polynomial modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = docs_of((1, " ".join([one] * 6)), (2, " ".join([other] * 6)), (3, " ".join([one] * 6) + " x"))
    found = {r.doc_id: r.class_id for r in neardup.class_of_each(docs).collect()}
    assert found[1] != found[2]
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect())[:2] == [1, 2]
