from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tillbook.llm import bytebpe, queries

PATH, PATTERN = queries.vocabulary()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def test_byte_characters_are_a_bijection():
    assert len(set(bytebpe.byte_characters())) == 256


def test_ids_match_another_implementation(reference):
    rnd = random.Random(3)
    pieces = ["the", "ing", " ", "aaaa", "  ", "\n\t", "-", "==", "\xa0", "é", "日本", "<|endoftext|>", "'re", "'S", "12", "\x00", "\U00018f88", "\x85"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x11_0000)])) for _ in range(20)) for _ in range(1500)]
    texts += ["a" * 30_000, "word " * 20_000]
    assert bytebpe.tokenizer(PATH, PATTERN).ids(texts) == [reference.encode_ordinary(t) for t in texts]


def test_round_trip_with_offsets(docs_of, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "CHUNK_CHARS", 50)
    texts = ["", None, "naïve 日本語 text", "\U0001f600" * 30, "same", "same", "x" * 500]
    ids = bytebpe.encode(docs_of(*enumerate(texts)), PATH, PATTERN, keep=["doc_id"])
    for r in ids.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.ids == reference.encode_ordinary(texts[r.doc_id] or "") and r.ends[-1:] == ([len(raw)] if raw else [])
    for r in bytebpe.decode(ids, PATH, keep=["doc_id"]).collect():
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bytebpe.encode(docs_of((1, "a")).limit(0), PATH, PATTERN, keep=["doc_id"]).count() == 0


def test_offsets_come_with_the_round_trip(spark, tmp_path, docs_of, reference):
    texts = ["", None, "naïve 日本語 text", "\U0001f600" * 30, "same", "same", "x" * 500]
    docs = docs_of(*enumerate(texts))
    rows = corpus_pipeline.token_ids(spark, docs, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [reference.decode_single_token_bytes(i) for i in r.ids]
        assert r.ends == [sum(map(len, tokens[: n + 1])) for n in range(len(tokens))] and r.round_trip
    for r in bytebpe.round_trip(docs, PATH, PATTERN, keep=["doc_id"]).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.ends[-1:] == ([len(raw)] if raw else []) and bytes(r.decoded) == raw
