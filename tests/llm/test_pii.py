from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from tillbook.llm import pii, queries

# the contract's patterns, as plain expressions
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind: str, match: str) -> bool:
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d // 10 + 2 * d % 10 for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), kind) for kind, pattern in PLAIN.items() for m in pattern.finditer(text) if passes(kind, m.group())]


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


TEXTS = [
    "é\U0001f600 write ann.b+c@mail5.example.com, or call +1 (743) 555-3824.", None, "", "card 4737097684299439 and order 4737097684299438",
    "hosts 152.143.123.131 and 300.1.2.3, version 1.2.3.4.5", "x@y a@b.co@c.org1 @@ é.z@q.de a@b.1 a@b.c1", "4111 1111 1111 1111 123",
    "x" * 2_000 + "@" + "y" * 2_000, "0123456789" * 300, "1 " * 1_500, "ann at mail dot example dot com", "010.2.3.4 at " + "0" * 4_000 + "1.2.3.4",
    "+49 30 1234567 and (743) 555-3824, 4222222222222", "4111111111111111 4111111111111111", "+1 743 555 3824 1 4111-1111-1111-1111 10.0.0.1",
]


def test_registered(spark, tmp_path, docs_of):
    docs_of(*enumerate(TEXTS), (0, TEXTS[0])).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op8_pii"](spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    found = {r.doc_id: r for r in rows}
    for i, text in enumerate(TEXTS):
        base, row = plain_base(text or ""), found[i]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for *_, k in base) for kind in PLAIN]
        assert row.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert {x for x in written(base).split(",") if x} <= set(row.spans.split(","))
    assert found[10].n_email == 0 and found[10].spans == "email:0:31"
    assert found[12].spans == "card:35:48,phone:0:14,phone:19:33" and found[6].spans == "card:0:19"
    assert found[1].spans == found[2].spans == found[8].spans == ""
    assert queries.QUERIES["op8_pii"](spark, str(tmp_path)).where("doc_id < 0").count() == 0


def test_registered_query_on_the_given_table(spark):
    """Every document of a given table, whole, against plain expressions."""
    rows = queries.QUERIES["op8_pii"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and any(r.n_ip for r in rows) and any(r.n_card for r in rows)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in base) for kind in PLAIN)
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert {x for x in written(base).split(",") if x} <= set(r.spans.split(","))


@pytest.mark.parametrize("text", ["x" * 500_000 + "@" + "y" * 500_000, "0123456789" * 100_000, "1 " * 500_000, "1." * 500_000 + "1", "+1" * 300_000])
def test_very_long_texts_take_linear_time(text):
    assert {k for *_, k in pii.base_spans(text)} <= {"ip"}


def test_empty_table(spark, docs_of):
    assert pii.scan(docs_of((1, "a@b.c")).where("doc_id = 2"), keep=["doc_id", "score"]).count() == 0


@pytest.mark.parametrize("letters", ["ab1.@@-é _", "0123456789. ", "+0123456789 -().", "4111 -1+", "0129.@a-+( )"])
def test_base_matches_the_plain_patterns(letters):
    rnd = random.Random(3)
    for _ in range(5_000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        if rnd.random() < 0.3:
            text += pii._card(rnd) + rnd.choice(["", " ", "-", "1"]) + text
        base = pii.base_spans(text)
        assert base == plain_base(text), text
        spans = pii.all_spans(base, pii.entities(text, base))
        added = set(spans) - set(base)
        assert set(base) <= set(spans) and all(y <= a or b <= x for a, b, k in added for x, y, other in spans if (x, y, other) != (a, b, k))


def test_best_segmentation_of_the_whole_text():
    """Stretches give what all tokens together give, and that is the best of all segmentations."""
    rnd = random.Random(4)
    for trial in range(60):
        weights = [rnd.uniform(-3, 3) for _ in pii.FEATURES] if trial % 2 else pii.WEIGHTS
        text, _ = pii.sample(trial, 1)[0]
        base = pii.base_spans(text)
        whole = pii.Lattice(text, 0, len(text), base)
        assert whole.best(weights) == pii.entities(text, base, weights)
        arcs = list(zip(whole.arcs, whole.features))[:10]
        scores = []
        for n in range(4):
            for some in itertools.combinations(arcs, n):
                some = sorted(some)
                if all(x[0][1] <= y[0][0] for x, y in zip(some, some[1:])):
                    score = sum(weights[f] for _, features in some for f in features)
                    for (x, _), (y, _) in zip(some, some[1:]):
                        if x[1] == y[0]:
                            score += weights[pii.FEATURES["after:same" if x[2] == y[2] else "after:other"]]
                    scores.append(score)
        best = {(a, b, k) for a, b, k in whole.best(weights)}
        mine = sum(weights[f] for (i, j, k), features in zip(whole.arcs, whole.features)
                   if (whole.cuts[i], whole.cuts[j], pii.KINDS[k]) in best for f in features)
        touching = sum(x[1] == y[0] for x, y in itertools.pairwise(sorted(best)))
        assert touching or mine >= max(scores) - 1e-9


def test_weights_are_the_fitted_ones():
    objective = pii.Objective(pii.sample(*pii.TRAINING))
    assert objective.lost == 0
    assert np.abs(objective(np.array(pii.WEIGHTS))[1]).max() < 1e-3


@pytest.mark.parametrize("seed", [99, 100])
def test_made_texts_not_trained_on(seed):
    right = found = there = 0
    for text, spans in pii.sample(seed, 500):
        got = set(pii.entities(text))
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right >= 0.96 * found and right >= 0.96 * there
