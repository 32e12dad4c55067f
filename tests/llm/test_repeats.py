"""Both removals of repeated passages against a loop over all windows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tillbook.llm import automaton, repeats, suffixdedup, words


def brute(rows, units, window):
    """Removed positions per row, in the order of ids; rows of one id in the order given."""
    seen, out = set(), {}
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n)):
        own = units(rows[n][1] or "")
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        out[n] = [u for u, g in zip(own, gone) if not g], int(gone.sum()), len(own), int((np.diff(np.concatenate([[0], gone])) == 1).sum())
    return out


@pytest.fixture(scope="module")
def rows(prose):
    rnd = random.Random(5)
    shared = [prose(1000 + i, 60) for i in range(4)]
    line = prose(2000, 12)
    out = []
    for i in range(80):
        parts = [prose(i, rnd.randrange(5, 120))]
        for _ in range(rnd.randrange(4)):
            parts += [rnd.choice([*shared, line, shared[0][: rnd.randrange(40, 200)], "aa " * 60, "é" * 130]), prose(rnd.randrange(10_000), 9)]
        out.append((rnd.randrange(10_000), "\n".join(parts)))
    out += [(out[0][0] + 10_000, out[0][1]), (20_001, ""), (20_002, None), (20_003, " \t\n"), (20_004, "a" * 5000), (20_005, "b c " * 2000)]
    ids = [i for i, _ in out]
    return [r for n, r in enumerate(out) if r[0] not in ids[:n]]


@pytest.fixture(params=[1 << 20, 1500])
def block_bytes(request, monkeypatch):
    """One block, and many."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", request.param)


def test_cover_has_every_difference():
    for module in (automaton, suffixdedup):
        assert {(a - b) % module.PERIOD for a in module.COVER for b in module.COVER} == set(range(module.PERIOD))


def test_bytes(docs_of, rows, block_bytes):
    want = brute(rows, lambda t: list(t.encode()), suffixdedup.LENGTH)
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(docs_of(*rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for n, (i, _) in enumerate(rows):
        kept, removed, size, runs = want[n]
        r = got[i]
        assert (bytes(r.kept), r.n_bytes, len(r.spans), sum(s.end - s.start for s in r.spans)) == (bytes(kept), size, runs, removed), i


def test_words(docs_of, rows, block_bytes):
    want = brute(rows, re.compile(r"[^\x20\x09-\x0D]+").findall, automaton.WINDOW)
    got = {r.doc_id: r for r in automaton.remove_repeats(docs_of(*rows).repartition(3)).collect()}
    for n, (i, _) in enumerate(rows):
        kept, removed, size, runs = want[n]
        r = got[i]
        assert (bytes(r.kept).decode(), r.n_words, len(r.spans), sum(s.end - s.start for s in r.spans)) == (" ".join(kept), size, runs, removed), i


def test_repeated_rows_null_ids_and_empty_tables(docs_of, prose):
    text = prose(1, 80)
    docs = docs_of((None, text), (5, text), (5, text), (4, "short"))
    for run, total in ((suffixdedup.remove_repeats, "n_bytes"), (automaton.remove_repeats, "n_words")):
        out = run(docs).collect()
        left = sorted((r.doc_id is None, r.doc_id or 0, bool(r.kept)) for r in out)
        assert left == [(False, 4, True), (False, 5, False), (False, 5, True), (True, 0, False)] and all(r[total] for r in out)
        assert run(docs.limit(0)).count() == 0


def test_automaton_finds_longest_matches():
    rnd = random.Random(2)
    words = [[rnd.choice("ab") for _ in range(30)] for _ in range(5)]
    own = automaton.SuffixAutomaton()
    for w in words:
        own.add(w)
    stream = [rnd.choice("ab") for _ in range(60)]
    inside = lambda s: any(w[i : i + len(s)] == s for w in words for i in range(len(w)))
    for end, matched in enumerate(own.matching(stream), 1):
        assert inside(stream[end - matched : end]) and (matched == end or not inside(stream[end - matched - 1 : end]))


@pytest.mark.parametrize("bits", [28, 9, 7])
def test_texts_longer_than_positions_fit(monkeypatch, prose, bits):
    """Anchors are found in runs of 2**bits numbers; here a few hundred stand for the 2**28 of a real text."""
    monkeypatch.setattr(repeats, "PLACE_BITS", bits)
    scheme = repeats.Scheme(suffixdedup.LENGTH, suffixdedup.PERIOD, suffixdedup.COVER, 1.0)
    shared = [prose(i, 60).encode() for i in range(3)]
    raw = b"".join(prose(100 + i, 5 + 13 * i % 40).encode() + shared[i % 3][: 150 + 37 * i % 200] for i in range(24)) + b"a" * 700
    own = repeats.Suffixes(scheme, words.byte_numbers()[np.frombuffer(raw, np.uint8)], np.array([0, 40, len(raw)]), 8)
    ids = np.array([1, 2])
    own.narrow(np.zeros(len(own.keys), bool))
    own.merge()
    equal = {}
    for start, end, anchor in zip(own.from_, own.to, own.anchors):
        for i in range(start, end + 1):
            assert equal.setdefault(raw[i : i + scheme.window], anchor) == anchor, i
    column = lambda parts: pa.array([x.tobytes() for x in parts], pa.binary())
    told = [np.zeros(0, np.uint8)]
    for bucket, *parts in own.sorted_stretches(ids):
        table = pa.table({"block": [0], "bucket": [bucket], **{n: column([x]) for n, x in zip(("anchors", "stretches", "ids"), parts)}})
        told.append(np.frombuffer(repeats._settled(table)["codes"][0].as_py(), np.uint8))
    own.settle(np.concatenate(told))
    none = np.zeros(0, np.uint8)
    sent = [len(keys) for _, keys, _ in own.sorted_windows(ids)]
    later, _, _ = own.answered(np.concatenate([none, *(np.full(n, repeats.ALONE, np.uint8) for n in sent)]), np.zeros(sum(sent), np.int64), ids)
    gone = own.cover(np.concatenate([own.settled, own.start[later]]))
    want, seen = np.zeros(len(raw), bool), set()
    for a, b in ((0, 40), (40, len(raw))):
        for i in range(a, b - scheme.window + 1):
            if raw[i : i + scheme.window] in seen:
                want[i : i + scheme.window] = True
            seen.add(raw[i : i + scheme.window])
    assert want.any() and gone.tolist() == want.tolist()


def test_long_words_that_sums_cannot_tell_apart(docs_of):
    """Words that any polynomial modulo 2**64 takes for the same: each has its own first occurrence."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = docs_of((1, " ".join([one] * 20)), (2, " ".join([other] * 20)), (3, " ".join([other] * 20)))
    found = {r.doc_id: sum(s["end"] - s["start"] for s in r.spans) for r in automaton.remove_repeats(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 20}
