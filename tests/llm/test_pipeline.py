"""Every stage's decisions take effect, on its predecessor's whole output, and nothing else changes."""

from __future__ import annotations

import random

import pytest
import tiktoken

import corpus_pipeline
from tillbook.llm import bytebpe, queries

SECRET = "aB3dE6gH9kL2mN5p"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs_of, prose):
    rnd = random.Random(8)
    out = str(tmp_path_factory.mktemp("corpus"))
    item = prose(900, 20)
    rows, labels = [], []
    for i in range(400):  # labelled, and clean but for the insults
        words = prose(i, 40).split()
        if i % 4 == 0:
            words[rnd.randrange(40)] = rnd.choice(["idiot", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    base = prose(1000, 80)
    rows += [
        (1000, base), (1001, base), (1002, base.replace(base.split()[40], "other", 1)), (1003, f"{prose(1001, 30)} you idiot"),
        (1004, f"{prose(1002, 20)} {item} {prose(1003, 20)}"), (1005, f"{prose(1004, 30)} token={SECRET}"),
        (1006, ""), (1007, None), (1008, None), (None, prose(1005, 30)), (1009, " ".join(item.split()[:9])), (1010, "é" * 3000),
    ]
    docs_of(*rows).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict((i, t) for i, t in rows if i is not None)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "byte_bpe"]


def test_each_stage_alone(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {name: stage(name)(spark, docs, path) for name in ("toxicity", "near_dedup", "decontamination", "secrets")}
    assert all(out.columns == docs.columns for out in left.values())
    ids = {name: sorted(r.doc_id for r in out.select("doc_id").dropna().collect()) for name, out in left.items()}
    assert set(texts) - set(ids["toxicity"]) == {i for i in texts if i < 400 and i % 4 == 0} | {1003}
    # 1006 is the one that stays of the empty and the null texts
    assert set(texts) - set(ids["near_dedup"]) == {1001, 1002, 1007, 1008}
    assert set(texts) - set(ids["decontamination"]) == {1004}
    redacted = {r.doc_id: r for r in left["secrets"].collect()}
    changed = {i for i in texts if redacted[i].text != texts[i]}
    assert changed == {1005} and redacted[1005].text == texts[1005].replace(f"token={SECRET}", "<secret>") and redacted[1005].n_chars == len(redacted[1005].text)
    assert all(out.where("doc_id is null").count() == 1 for out in left.values())


def test_whole_pipeline(spark, folder):
    path, texts = folder
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    gone = {i for i in texts if i < 400 and i % 4 == 0} | {1001, 1002, 1003, 1004, 1007, 1008}
    assert set(rows) == (set(texts) - gone) | {None}
    vocabulary, pattern = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(vocabulary), special_tokens={})
    for i, r in rows.items():
        if i is not None:
            want = own.encode_ordinary((texts[i] or "").replace(f"token={SECRET}", "<secret>"))
            assert r.ids == want and r.n_tokens == len(want)
        assert r.round_trip


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
