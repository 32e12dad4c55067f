"""The registered queries over whole tables against plain Python, digests included."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF
from tests.llm.test_repeats import brute
from tests.llm.test_sharding import jump
from tillbook.llm import queries


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def documents():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    ids = [r["doc_id"] for r in rows]
    assert len(set(ids)) == len(ids) > 0
    return [(r["doc_id"], r["text"]) for r in rows]


def result(spark, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, SF).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, documents):
    got, slots = result(spark, "op1_sharding"), {}
    assert set(got) == {i for i, _ in documents}
    for i, text in documents:
        raw = (text or "").encode()
        r = got[i]
        want = (len(raw) + 8, None if text is None else zlib.crc32(raw), "key", jump(i % 2**64, 24), jump(i % 2**64, 25))
        assert (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) == want, i
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5(spark, documents):
    want, got = brute(documents, re.compile(r"[^\x20\x09-\x0D]+").findall, 20), result(spark, "op5_substring_automaton")
    for n, (i, _) in enumerate(documents):
        kept, removed, size, _ = want[n]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (size, removed, sha(" ".join(kept).encode())), i
    assert len(got) == len(documents)


def test_op6(spark, documents):
    want, got = brute(documents, lambda t: list(t.encode()), 100), result(spark, "op6_suffix_dedup")
    for n, (i, _) in enumerate(documents):
        kept, removed, size, runs = want[n]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (size, removed, runs, sha(bytes(kept))), i
    assert len(got) == len(documents)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_in(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_op7(spark, documents):
    got, some = result(spark, "op7_secrets"), 0
    for i, text in documents:
        spans = secrets_in(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        count = lambda kind: sum(k == kind for k, _, _ in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (count("assign"), count("access"), count("hex"), sha(written.encode())), i
        assert set(filter(None, written.split(","))) <= set(r.spans.split(",")), i
        some += len(spans)
    assert len(got) == len(documents) and some


def test_op9(spark, documents):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = {}
    for item in pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"]).to_pylist():
        own = words(item["text"])
        k = min(10, len(own))
        for n in range(len(own) - k + 1 if own else 0):
            windows.setdefault(tuple(own[n : n + k]), set()).add(str(item["item_id"]))
    sizes, got, some = {len(w) for w in windows}, result(spark, "op9_decontamination"), 0
    for i, text in documents:
        own, hit, items = words(text), set(), set()
        for k in sizes:
            for n in range(len(own) - k + 1):
                there = windows.get(tuple(own[n : n + k]))
                if there:
                    hit.update(range(n, n + k))
                    items |= there
        r = got[i]
        want = (len(own), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, i
        some += bool(hit)
    assert len(got) == len(documents) and some


def test_op10(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines.read().splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op10_byte_bpe")
    for i, text in documents:
        ids = plain.encode_ordinary(text or "")
        want = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, i
    assert len(got) == len(documents)


def test_op4(spark):
    """Over sf0.1: in the smaller tables the held-out part has one and six toxic documents, too few to judge by."""
    folder = SF.replace("sf0.001", "sf0.1")
    rows = queries.QUERIES["op4_toxicity"](spark, folder).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == pq.read_metadata(f"{folder}/documents.parquet").num_rows
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0), i
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    held = [(r, bool(labels[i])) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    toxic, clean = ([r for r, t in held if t == side] for side in (True, False))
    above = np.mean([(a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean])
    caught, wronged = (np.mean([r.predicted for r in side]) for side in (toxic, clean))
    assert len(toxic) > 50 and above > 0.95 and caught > 0.9 and wronged < 0.01, (len(toxic), above, caught, wronged)
