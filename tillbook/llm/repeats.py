"""Which windows of a corpus also start earlier in it: difference-cover sample, then one suffix bucket at a time.

Texts are sequences of numbers (bytes or word hashes). A difference cover modulo
``period`` marks positions such that any two equal windows hold a pair of marked
positions at the same offset, with ``depth`` further numbers inside the window.

1. Sample: the marked suffixes are ranked to that depth, one bucket at a time.
   A suffix whose rank has no tie in the corpus takes its surroundings out: no
   window there can be repeated. What is left are the suffixes with long ties.
2. (``merge``) Neighbouring suffixes that share their anchor, the smallest hash
   in the window, are one stretch. Equal stretches tie as wholes: all but the
   earliest are settled. If all stretches of an anchor are equal, the earliest
   is settled as well, as equal windows have equal anchors.
3. The suffixes still open are sorted to window depth, again one bucket at a time,
   each bucket small enough for one task; the earliest of each class is its first.

Buckets are value ranges of 64-bit fingerprints, so they are even, and a block of
texts sends each distinct value once, so no value gathers more rows than there
are blocks. Blocks are checkpointed; answers come back per block in the order sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.words import Rolling, chunks, mix, text_bytes
from tillbook.session import cut_lineage

# Text of one block, in bytes.
BLOCK_BYTES = 1 << 20
# Sample keys of one bucket, on average; a bucket is sorted in memory.
BUCKET_KEYS = 500_000
_LAST = np.iinfo(np.int64).max
# Bits of a position within a run of numbers whose anchors are looked for together.
PLACE_BITS = 28
# What a bucket says of a key: no other, first of several, later than an equal one, to be told by its windows.
ALONE, FIRST, LATER, OPEN = 0, 1, 2, 3

_BLOCK = "bytes long, ids binary, nulls binary, offsets binary, blob binary"


@dataclass(frozen=True)
class Scheme:
    """Windows of ``window`` numbers; ``cover``: a difference cover modulo ``period``."""

    window: int
    period: int
    cover: tuple[int, ...]
    per_byte: float  # numbers per byte of text, about

    @property
    def depth(self) -> int:
        return self.window - self.period + 1

    def buckets(self, total_bytes: int) -> int:
        keys = total_bytes * self.per_byte * len(self.cover) / self.period
        return 1 << max(3, math.ceil(math.log2(max(1.0, keys / BUCKET_KEYS))))


def pack(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """Blocks of about a megabyte of text, by id within the block.

    Checkpointed, so blocks stay as they are, and dealt by block number, so the
    answers can be joined to them without moving the texts again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for part in chunks(sizes, BLOCK_BYTES):
                own = batch.slice(part.start, part.stop - part.start)
                ids = own.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                nulls = own.column(0).is_null().to_numpy(zero_copy_only=False)
                order = np.lexsort((ids, nulls))
                raw, offsets = text_bytes(own.column(1).take(pa.array(order)))
                row = (len(raw), ids[order].tobytes(), nulls[order].tobytes(), offsets.astype(np.int64).tobytes(), squeeze.compress(raw.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["bytes", "ids", "nulls", "offsets", "blob"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _BLOCK)
    return _dealt(rows.withColumn("block", F.monotonically_increasing_id()), "block")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Checkpoints rows by ``key`` so that joins on it find them in place.

    Spark keeps the partitioning of a checkpoint only where it is planned in advance.
    """
    conf = rows.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(rows.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


class Block:
    """The texts of one row of ``pack``."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["bytes"])), np.uint8)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


class Suffixes:
    """Sample keys and windows of the texts of a block, given as numbers and the offsets between texts."""

    def __init__(self, scheme: Scheme, numbers: np.ndarray, offsets: np.ndarray, buckets: int):
        self.scheme, self.offsets, self.buckets = scheme, offsets, buckets
        self.n = len(numbers)
        # 32 bits are enough for positions within a block, and faster
        small = offsets.astype(np.int32)
        place = np.arange(self.n, dtype=np.int32)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.left = np.repeat(small[1:], np.diff(offsets)) - place
        self.rolling = Rolling(numbers)
        marked = np.zeros(scheme.period, bool)
        marked[list(scheme.cover)] = True
        inside = place - np.repeat(small[:-1], np.diff(offsets))
        self.at = np.flatnonzero(marked[inside % scheme.period] & (self.left >= scheme.depth))
        keys = self.rolling.at(self.at, scheme.depth)
        self.keys, self.own, self.count = np.unique(keys, return_inverse=True, return_counts=True)

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.buckets.bit_length() + 1)).astype(np.int64)

    def sample(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, 32 further bits of every distinct sample key in it)."""
        bits = self.buckets.bit_length() - 1
        short = ((self.keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(self.bucket_of(self.keys), np.arange(self.buckets + 1))
        for bucket in np.flatnonzero(np.diff(edges)):
            yield int(bucket), short[edges[bucket] : edges[bucket + 1]]

    def narrow(self, tied: np.ndarray) -> None:
        """Keeps the windows that hold a tied sample suffix; ``tied`` is in the order of ``sample``."""
        flagged = (tied | (self.count > 1))[self.own]
        hit = self.at[flagged]
        first = np.maximum(hit - (self.scheme.period - 1), self.offsets[:-1][self.text[hit]])
        depth = np.cumsum(np.bincount(first, minlength=self.n + 1) - np.bincount(hit + 1, minlength=self.n + 1))
        self.settled = np.zeros(0, np.int64)
        self._open((depth[: self.n] > 0) & (self.left >= self.scheme.window))

    def merge(self) -> None:
        """Puts windows together to stretches with a common anchor; those without an open window are left out."""
        window, depth = self.scheme.window, self.scheme.depth
        span = window - depth + 1
        place = np.uint64((1 << PLACE_BITS) - 1)
        at = np.flatnonzero(self.left >= window)
        anchor = np.zeros(len(at), np.int64)
        rough = self.rolling.rough(depth)
        # runs overlap by a span, so every window lies whole in the run that has its start
        each = (1 << PLACE_BITS) - span + 1
        for begin in range(0, self.n, each):
            size = min(each + span - 1, self.n - begin)
            value = np.full(size, ~np.uint64(0))
            own = rough[begin : begin + size]
            value[: len(own)] = (own & ~place) | np.arange(len(own), dtype=np.uint64)
            value[self.left[begin : begin + size] < depth] = ~np.uint64(0)
            width = 1
            while width < span:  # smallest of the next ``width`` positions, up to ``span``
                step = min(width, span - width)
                upto = max(0, size - step)
                value[:upto] = np.minimum(value[:upto], value[step : step + upto])
                width += step
            first, last = np.searchsorted(at, [begin, begin + each])
            anchor[first:last] = (value[at[first:last] - begin] & place).astype(np.int64) + begin
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at)) - 1 if len(head) else head
        is_open = np.zeros(self.n + 1, np.int64)
        is_open[self.start + 1] = 1
        opened = np.cumsum(is_open)
        use = opened[at[last] + 1] > opened[at[head]]
        self.from_, self.to, anchor = at[head[use]], at[last[use]], anchor[head[use]]
        self.anchors = self.rolling.at(anchor, depth)
        self.stretches = mix(self.rolling.at(self.from_, self.to - self.from_ + window) ^ (anchor - self.from_).astype(np.uint64))
        order = np.lexsort((self.from_, self.stretches, self.anchors))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.anchors[order[1:]] != self.anchors[order[:-1]]) | (self.stretches[order[1:]] != self.stretches[order[:-1]])
        self.earliest = np.zeros(len(order), bool)
        self.earliest[order[fresh]] = True
        mine = np.flatnonzero(self.earliest)
        self.told = mine[np.argsort(self.bucket_of(self.anchors[mine]), kind="stable")]

    def sorted_stretches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, anchors, stretches, ids) of every distinct stretch, where it starts first in the block."""
        anchors, stretches, owner = self.anchors[self.told], self.stretches[self.told], ids[self.text[self.from_[self.told]]]
        edges = np.searchsorted(self.bucket_of(anchors), np.arange(self.buckets + 1))
        for bucket in np.flatnonzero(np.diff(edges)):
            part = slice(edges[bucket], edges[bucket + 1])
            yield int(bucket), anchors[part], stretches[part], owner[part]

    def settle(self, code: np.ndarray) -> None:
        """Takes the answers on stretches, in the order sent; leaves the windows open that need their own."""
        own = np.full(len(self.from_), LATER, np.uint8)
        own[self.told] = code
        was = np.zeros(self.n + 1, bool)
        was[self.start] = True
        flags = []
        for wanted in (LATER, OPEN):
            use = own == wanted
            depth = np.bincount(self.from_[use], minlength=self.n + 2) - np.bincount(self.to[use] + 1, minlength=self.n + 2)
            flags.append((np.cumsum(depth)[: self.n] > 0))
        self.settled = np.flatnonzero(flags[0])
        self._open(flags[1] & was[: self.n])

    def _open(self, flags: np.ndarray) -> None:
        self.start = np.flatnonzero(flags)
        self.distinct = None

    def _windows(self) -> None:
        """The distinct windows at ``start``, only once no more of them can be left out."""
        if self.distinct is None:
            self.distinct = np.unique(
                self.rolling.at(self.start, self.scheme.window), return_index=True, return_inverse=True, return_counts=True)
            self.windows, self.first, self.same, self.times = self.distinct
            # sent by bucket and, within it, by position: the ids then come in runs
            self.sent = np.lexsort((self.first, self.bucket_of(self.windows)))

    def sorted_windows(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, keys, ids) of every distinct window left, where it starts first in the block."""
        self._windows()
        keys = self.windows[self.sent]
        owner = ids[self.text[self.start[self.first[self.sent]]]] if len(keys) else np.zeros(0, np.int64)
        edges = np.searchsorted(self.bucket_of(keys), np.arange(self.buckets + 1))
        for bucket in np.flatnonzero(np.diff(edges)):
            part = slice(edges[bucket], edges[bucket + 1])
            yield int(bucket), keys[part], owner[part]

    def answered(self, code: np.ndarray, ref: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window left: is it later than an equal one, the id that holds the first, and is it a first with later ones."""
        self._windows()
        by_key, ref_of = np.zeros(len(self.windows), np.uint8), np.zeros(len(self.windows), np.int64)
        by_key[self.sent], ref_of[self.sent] = code, ref
        local = np.arange(len(self.start)) == self.first[self.same] if len(self.start) else np.zeros(0, bool)
        elsewhere = by_key[self.same] == LATER if len(self.start) else np.zeros(0, bool)
        if not len(self.start):
            return elsewhere, np.zeros(0, np.int64), local
        own = ids[self.text[self.start[self.first]]]
        refs = np.where(by_key == LATER, ref_of, own)[self.same]
        later = elsewhere | ~local
        first = local & ~elsewhere & ((by_key[self.same] == FIRST) | (self.times[self.same] > 1))
        return later, refs, first

    def cover(self, start: np.ndarray) -> np.ndarray:
        """Which numbers the windows at ``start`` cover."""
        depth = np.bincount(start, minlength=self.n + 1) - np.bincount(start + self.scheme.window, minlength=self.n + 1)
        return np.cumsum(depth)[: self.n] > 0


Numbers = Callable[[Block], tuple[np.ndarray, np.ndarray]]


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _tied(table: pa.Table) -> pa.Table:
    """One bucket of the sample: which keys more than one block has."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["keys"]]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    tied = np.zeros(len(keys), bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    edges = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(tied[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "tied": pa.array(bits, pa.binary()), "n": pa.array(np.diff(edges), pa.int32())})


def _settled(table: pa.Table) -> pa.Table:
    """One bucket of stretches: for each sent, alone or first, later, or open if its anchor has other stretches too."""
    anchors, stretches, ids = (
        np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
        for name, kind in (("anchors", np.uint64), ("stretches", np.uint64), ("ids", np.int64))
    )
    sizes = [x.as_buffer().size // 8 for x in table["ids"]]
    order = np.lexsort((np.repeat(table["block"].to_numpy(), sizes), ids, stretches, anchors))
    other = np.ones(len(order), bool)
    other[1:] = anchors[order[1:]] != anchors[order[:-1]]
    new = other.copy()
    new[1:] |= stretches[order[1:]] != stretches[order[:-1]]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(other))
    several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(other), len(order))))
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.where(~new, LATER, np.where(several, OPEN, FIRST))
    edges = np.cumsum([0, *sizes])
    out = [codes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "codes": pa.array(out, pa.binary())})


def _firsts(table: pa.Table) -> pa.Table:
    """One bucket of windows: for each key sent, alone, first, or later and then the id of the first."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]]
    ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["ids"]])
    sizes = [len(p) for p in parts]
    keys, block = np.concatenate(parts), np.repeat(table["block"].to_numpy(), sizes)
    order = np.lexsort((block, ids, keys))
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(keys)))
    code = np.where(new, np.where(np.repeat(size, size) > 1, FIRST, ALONE), LATER).astype(np.uint8)
    codes, refs = np.empty(len(keys), np.uint8), np.empty(len(keys), np.int64)
    codes[order], refs[order] = code, np.repeat(ids[order[head]], size)
    edges = np.cumsum([0, *sizes])
    out = [(codes[a:b], refs[a:b][codes[a:b] == LATER]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({
        "block": table["block"], "bucket": table["bucket"],
        "codes": pa.array([c.tobytes() for c, _ in out], pa.binary()), "refs": pa.array([r.tobytes() for _, r in out], pa.binary()),
        "firsts": pa.array([int((c == FIRST).sum()) for c, _ in out], pa.int32()),
    })


@dataclass(frozen=True)
class Reader:
    """Reads a block row that carries the answers of both steps."""

    scheme: Scheme
    numbers: Numbers
    buckets: int

    def suffixes(self, row: dict) -> tuple[Block, Suffixes, np.ndarray, np.ndarray, np.ndarray]:
        """Block, its suffixes, and per window left: later, id of the first, is a first."""
        block, own = _narrowed(self.scheme, self.numbers, self.buckets, row)
        if "stretches" in row:
            _settle(own, row)
        answers = row["answers"] or []
        code = np.concatenate([np.frombuffer(a["codes"], np.uint8) for a in answers] or [np.zeros(0, np.uint8)])
        ref = np.zeros(len(code), np.int64)
        ref[code == LATER] = np.concatenate([np.frombuffer(a["refs"], np.int64) for a in answers] or [np.zeros(0, np.int64)])
        return block, own, *own.answered(code, ref, block.ids)


def _narrowed(scheme: Scheme, numbers: Numbers, buckets: int, row: dict) -> tuple[Block, Suffixes]:
    block = Block(row)
    own = Suffixes(scheme, *numbers(block), buckets)
    found = [np.unpackbits(np.frombuffer(t["tied"], np.uint8), count=t["n"]).astype(bool) for t in row["ties"] or []]
    own.narrow(np.concatenate([*found, np.zeros(0, bool)]))
    return block, own


def _settle(own: Suffixes, row: dict) -> None:
    own.merge()
    own.settle(np.concatenate([*(np.frombuffer(a["codes"], np.uint8) for a in row["stretches"] or []), np.zeros(0, np.uint8)]))


def search(blocks: DataFrame, scheme: Scheme, numbers: Numbers, *, merge: bool = False) -> tuple[DataFrame, Reader, int]:
    """Runs the steps; gives the blocks with their answers, a reader of them, and how many windows are first of several."""
    buckets = scheme.buckets(blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block = Block(row)
            found = list(Suffixes(scheme, *numbers(block), buckets).sample())
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.int32()), pa.array([block.block] * len(found), pa.int64()), pa.array([k.tobytes() for _, k in found], pa.binary())],
                ["bucket", "block", "keys"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block, own = _narrowed(scheme, numbers, buckets, row)
            if merge:
                _settle(own, row)
            found = list(own.sorted_windows(block.ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in found], pa.int32()), pa.array([block.block] * len(found), pa.int64()),
                 pa.array([k.tobytes() for _, k, _ in found], pa.binary()), pa.array([i.tobytes() for _, _, i in found], pa.binary())],
                ["bucket", "block", "keys", "ids"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block, own = _narrowed(scheme, numbers, buckets, row)
            own.merge()
            found = list(own.sorted_stretches(block.ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int32()), pa.array([block.block] * len(found), pa.int64()),
                 *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (1, 2, 3))],
                ["bucket", "block", "anchors", "stretches", "ids"])

    gathered = lambda df, name, *columns: df.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias(name))
    ties = blocks.mapInArrow(sample, "bucket int, block long, keys binary").groupBy("bucket").applyInArrow(_tied, "block long, bucket int, tied binary, n int")
    ties = cut_lineage(gathered(ties, "ties", "tied", "n"))
    narrowed = blocks.join(ties, "block", "left")
    if merge:
        sent = narrowed.mapInArrow(stretches, "bucket int, block long, anchors binary, stretches binary, ids binary")
        settled = sent.groupBy("bucket").applyInArrow(_settled, "block long, bucket int, codes binary")
        narrowed = narrowed.join(cut_lineage(gathered(settled, "stretches", "codes")), "block", "left")
    sent = narrowed.mapInArrow(windows, "bucket int, block long, keys binary, ids binary")
    answers = sent.groupBy("bucket").applyInArrow(_firsts, "block long, bucket int, codes binary, refs binary, firsts int")
    answers = cut_lineage(gathered(answers, "answers", "codes", "refs", "firsts"))
    firsts = answers.select(F.aggregate("answers", F.lit(0).cast("long"), lambda n, a: n + a["firsts"]).alias("n")).agg(F.sum("n")).first()[0]
    return narrowed.join(answers, "block", "left"), Reader(scheme, numbers, buckets), int(firsts or 0)


def runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of flags within a group of neighbours."""
    on = np.concatenate([[False], flags, [False]])
    start = on[1:-1] & ~on[:-2]
    end = on[1:-1] & ~on[2:]
    if len(flags):
        edge = np.ones(len(flags), bool)
        edge[1:] = group[1:] != group[:-1]
        start |= flags & edge
        end |= flags & np.append(edge[1:], True)
    return np.flatnonzero(start), np.flatnonzero(end) + 1
