from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from tillbook.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark, docs_of, prose):
    """Insults decide; a group is named in most toxic texts and in few others."""
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.3
        words = prose(i, rnd.randrange(20, 60), 300).split()
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum", "loweiss", "loweinig"]))
        if rnd.random() < (0.8 if toxic else 0.03):
            words.insert(rnd.randrange(len(words)), "muslims")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 0))
    rows += [(1000, None), (1001, ""), (1002, "x" * 100_000), (None, "idiot")]
    labels += [(None, 1, 0), (3000, None, 0), (0, 0, 0)]
    return docs_of(*rows), spark.createDataFrame(labels, "doc_id long, toxic int, score int"), dict(labels_of(labels))


def labels_of(labels):
    return [(i, t) for i, t, _ in labels if i is not None and t is not None]


def test_held_out_texts_are_told_apart(labelled):
    docs, labels, truth = labelled
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [r for i, r in rows.items() if i in truth and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and not rows[None].held_out
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert rows[1000].score == rows[1001].score and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.predicted == (r.score >= 0.5) for r in rows.values())


def test_naming_a_group_counts_less_with_the_penalty(spark, labelled, docs_of, monkeypatch):
    docs, labels, _ = labelled
    neutral = docs_of((1, "w1 w2 muslims w3"), (2, "w1 w2 christians w3"), (3, "w1 w2 w3"))
    train = toxicity._train

    def gap(penalty):
        monkeypatch.setattr(toxicity, "_train", lambda *a: train(*a, penalty=penalty))
        model = toxicity.fit(docs, labels)
        scored = neutral.select("doc_id", toxicity.score_of(model)(neutral["text"]).alias("p")).collect()
        score = {r.doc_id: r.p for r in scored}
        return abs(score[1] - score[2]), score[1] - score[3]

    (plain_change, plain_rise), (change, rise) = gap(0.0), gap(4.0)
    assert change < 0.5 * plain_change and rise < plain_rise


def test_without_labels_nothing_is_toxic(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_documents(docs_of((1, "idiot"), (2, None)), labels).collect()
    assert len({r.score for r in out}) == 1 and not any(r.predicted for r in out)
    assert toxicity.score_documents(docs_of((1, "a")).limit(0), labels).count() == 0


BASE, MASK = 0x9E3779B97F4A7C15, 2**64 - 1


def mixed(x: int) -> int:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & MASK
    return x


def of_bytes(word: bytes) -> int:
    return mixed(sum(mixed((b + 1) * BASE & MASK) * pow(BASE, j, 2**64) for j, b in enumerate(word)) & MASK)


def plain_features(text: str | None) -> set[int]:
    found = set()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        digest = hashlib.blake2b(word, digest_size=8).digest()
        found.add(int.from_bytes(digest, "little") if len(word) >= 256 else of_bytes(word))
        found |= {mixed((of_bytes(word[:n]) + n) & MASK) for n in (4, 5) if len(word) > n}
    return found


def test_scores_are_those_of_a_loop_over_words(spark, labelled, docs_of):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert len(weight) > 50
    more = docs_of((5000, "IDIOT idiot, Idiot-scum"), (5001, "Ärger muslims\tMUSLIMS"), (5002, "y" * 300 + " scum"), (5003, "loweiß\n" * 50_000), (5003, "again"))
    every = docs.unionByName(more)
    got = every.select("text", toxicity.score_of(model)(every["text"]).alias("p")).collect()
    assert len(got) == docs.count() + 5
    for text, p in got:
        odds = model.bias + sum(weight.get(f, 0.0) for f in plain_features(text))
        assert abs(p - 1 / (1 + math.exp(-odds))) < 1e-9, (text or "")[:60]


def test_repeated_documents_keep_their_rows(labelled):
    docs, labels, _ = labelled
    once = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    twice = toxicity.score_documents(docs.unionByName(docs), labels).collect()
    assert len(twice) == 2 * len(once)
    by_id = {}
    for r in twice:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(scores) == 1 for scores in by_id.values())
