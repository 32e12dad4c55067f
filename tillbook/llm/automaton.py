"""Word-wise removal of long repeated passages by suffix automata of reference shards.

The passages that occur first and again later are the reference. It is dealt to
shards of bounded size by the document that holds it; each shard's automaton is
sent to as many tasks as its stream of later text needs. The later text is run
through it; matching statistics of at least a window's length are removed.

An automaton of everything sent everywhere would cost the square of the corpus,
so fingerprints first tell which text can match at all, and which shard it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.repeats import Block, Scheme, Suffixes, block_rows, pack, runs, search
from tillbook.llm.words import Rolling, byte_numbers, mix, not_space, word_spans, word_hashes
from tillbook.session import cut_lineage

WINDOW = 20
# The differences of these numbers are all residues modulo 13.
PERIOD = 13
COVER = (0, 1, 3, 9)
# Words of a shard's reference, on average, and of the stream that one task runs through it.
SHARD_WORDS = 40_000
STREAM_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of the sequences added to it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol) -> int:
        """The state for the longest string of ``p`` followed by the symbol."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list) -> None:
        last = 0
        for symbol in symbols:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, symbol)
            last = new

    def matching(self, symbols: list) -> Iterator[int]:
        """For each symbol, the length of the longest match that ends there."""
        state = matched = 0
        after, link, length = self.next, self.link, self.length
        for symbol in symbols:
            while state and symbol not in after[state]:
                state = link[state]
                matched = length[state]
            if symbol in after[state]:
                state = after[state][symbol]
                matched += 1
            yield matched


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a block, and the offsets of its texts in words."""
    starts, ends, text = word_spans(block.raw, block.offsets, not_space())
    return starts, ends, np.searchsorted(text, np.arange(len(block.offsets)))


def _numbers(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, offsets = _words(block)
    return word_hashes(block.raw, Rolling(byte_numbers()[block.raw]), starts, ends), offsets


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and where each begins."""
    lengths = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], lengths)
    out = raw[np.minimum(index, max(0, len(raw) - 1))].copy() if len(index) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 0x20
    return out, begin


def _pieces(block: Block, own: Suffixes, later: np.ndarray, refs: np.ndarray, first: np.ndarray, shards: int) -> Iterator[tuple]:
    """(shard, is reference, text number, first word, words) of the runs of windows of either kind."""
    starts, ends, offsets = _words(block)
    for reference, flags, owner in ((True, first, None), (False, later, refs)):
        at = own.start[flags]
        if not len(at):
            continue
        text = own.text[at]
        owner = block.ids[text] if owner is None else owner[flags]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        shard = (mix(owner[head].view(np.uint64)) % np.uint64(shards)).astype(int)
        for s, t, a, b in zip(shard.tolist(), text[head].tolist(), at[head].tolist(), (at[tail] + WINDOW).tolist()):
            words = b" ".join(block.raw[i:j].tobytes() for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist()))
            yield s, reference, t, a - int(offsets[t]), b - a, words


def _streamed(table: pa.Table) -> pa.Table:
    """One shard, or a salt of it: builds the automaton and runs the later text through it."""
    automaton = SuffixAutomaton()
    reference = table["reference"].to_pylist()
    words = table["words"].to_pylist()
    for passage in {w for w, r in zip(words, reference) if r}:
        automaton.add(passage.split(b" "))
    out = []
    known: dict[bytes, list[tuple[int, int]]] = {}
    for i, is_reference in enumerate(reference):
        if is_reference:
            continue
        if words[i] not in known:
            reached = np.fromiter(automaton.matching(words[i].split(b" ")), np.int64)
            hit = np.flatnonzero(reached >= WINDOW)
            gone = np.zeros(len(reached), bool)
            for end in hit.tolist():
                gone[end + 1 - WINDOW : end + 1] = True
            known[words[i]] = list(zip(*(x.tolist() for x in runs(gone, np.zeros(len(gone), int)))))
        block, text, start = table["block"][i].as_py(), table["text"][i].as_py(), table["start"][i].as_py()
        out += [(block, text, start + a, start + b) for a, b in known[words[i]]]
    columns = list(zip(*out)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "text", "start", "end"), columns, kinds)})


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, spans, kept for every row of ``docs``.

    Words are runs of other characters than space and tab to carriage return. A
    word goes if WINDOW words over it also start earlier: in a row of a smaller
    id, or before in the same text. Null ids come last; rows of the same id follow
    one another in a fixed but arbitrary order. spans are the maximal runs
    removed, as (start, end) in words; kept are the other words joined by one
    space, in bytes. Null texts have no words; texts of fewer than WINDOW words
    lose nothing. Other columns are ignored; an empty table gives no rows.
    """
    blocks = pack(docs, id=id, text=text)
    answered, reader, firsts = search(blocks, Scheme(WINDOW, PERIOD, COVER, 1 / 6), _numbers)
    shards = max(1, math.ceil(firsts / SHARD_WORDS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "shard", "reference", "text", "start", "n", "words"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for row in block_rows(batches):
            block, own, later, refs, first = reader.suffixes(row)
            rows = [(block.block, *piece) for piece in _pieces(block, own, later, refs, first, shards)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    pieces = cut_lineage(answered.mapInArrow(
        cut, "block long, shard int, reference boolean, text int, start int, n int, words binary"))
    stream = pieces.where("not reference")
    salts = stream.groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("salts"))
    sent = (
        pieces.join(salts, "shard")
        .withColumn("salt", F.explode(F.when(F.col("reference"), F.sequence(F.lit(0), F.col("salts") - 1))
                                      .otherwise(F.array(F.pmod(F.xxhash64("block", "text", "start"), F.col("salts")).cast("int")))))
        .drop("salts")
    )
    gone = sent.groupBy("shard", "salt").applyInArrow(_streamed, "block long, text int, start int, end int")
    gone = gone.groupBy("block").agg(F.collect_list(F.struct("text", "start", "end")).alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block = Block(row)
            starts, ends, offsets = _words(block)
            depth = np.zeros(len(starts) + 1, np.int64)
            if row["gone"]:
                base = offsets[[g["text"] for g in row["gone"]]]
                np.add.at(depth, base + [g["start"] for g in row["gone"]], 1)
                np.add.at(depth, base + [g["end"] for g in row["gone"]], -1)
            removed = np.cumsum(depth)[: len(starts)] > 0
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            first, last = runs(removed, owner)
            pairs = pa.StructArray.from_arrays(
                [pa.array((x - offsets[:-1][owner[first]]).astype(np.int32)) for x in (first, last)], ["start", "end"])
            at = np.searchsorted(owner[first], np.arange(len(offsets)))
            kept, begin = _joined(block.raw, starts[~removed], ends[~removed])
            edges = begin[np.searchsorted(owner[~removed], np.arange(len(offsets)))]
            yield pa.RecordBatch.from_arrays([
                block.id_column(),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs),
                pa.array([kept[a : max(a, b - 1)].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            ], [id, "n_words", "spans", "kept"])

    return blocks.join(gone, "block", "left").mapInArrow(
        finish, f"`{id}` long, n_words long, spans array<struct<start:int,end:int>>, kept binary")
