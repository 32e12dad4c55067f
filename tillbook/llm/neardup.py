"""Near duplicates by ProbMinHash over weighted word shingles.

Every shingle is a Poisson process whose rate is its weight; its arrivals, the
same in all texts but for the rate, fall on random registers, and a register
keeps its earliest. A shingle stops as soon as its next arrival would be later
than all registers hold. Two texts agree in a register with probability equal
to the probability Jaccard similarity of their weights.

Bands of registers propose groups of texts; within a group, texts are compared
in blocks, first by registers, then exactly, and only links that join two
classes are written. Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.components import components
from tillbook.llm.words import Words, chunks, mix, not_space
from tillbook.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
# 32 bands of 6 registers: a pair at the threshold is missed with probability 6e-5, less above it.
BANDS, BAND_ROWS = 32, 6
REGISTERS = BANDS * BAND_ROWS
# A pair whose registers agree in fewer than similarity - 5 standard errors isn't compared exactly.
SLACK = 5.0
# Members of a group that meet in one task; larger groups meet block by block.
BLOCK = 512
TEXTS_IN_CHUNK = 1000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def node_of(text):
    """Identity of a text: 16 bytes; a null text counts as empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def weighted_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted; a text of fewer words is one shingle, one without words has none."""
    text, _, shingle = Words(texts, not_space()).shingles(size)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Registers (texts x REGISTERS) with the fingerprint of the shingle that arrived first."""
    earliest = np.full(texts * REGISTERS, np.inf)
    winner = np.zeros(texts * REGISTERS, np.uint64)
    reached = np.zeros(len(text))
    live, done, burst = np.arange(len(text)), 0, 1
    latest = np.full(texts, np.inf)
    while len(live):
        # the next arrivals of every live shingle; bursts double, as few shingles are left by then
        number = (np.arange(done + 1, done + burst + 1, dtype=np.uint64) * _STEP)[None, :]
        draw = mix(shingle[live][:, None] + number)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
        time = reached[live][:, None] + np.cumsum(gap, axis=1)
        reached[live] = time[:, -1]
        register = (mix(draw) % np.uint64(REGISTERS)).astype(np.int64) + (text[live] * REGISTERS)[:, None]
        time = time / weight[live][:, None]
        use = time < latest[text[live]][:, None]
        register, time = register[use], time[use]
        owner = np.broadcast_to(shingle[live][:, None], use.shape)[use]
        np.minimum.at(earliest, register, time)
        won = earliest[register] == time
        winner[register[won]] = owner[won]
        latest = earliest.reshape(texts, REGISTERS).max(axis=1)
        live = live[reached[live] / weight[live] < latest[text[live]]]
        done, burst = done + burst, min(2 * burst, 64)
    return winner.reshape(texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    rows = registers.reshape(-1, BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, rows.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = mix(key ^ rows[:, :, i])
    return key


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two weighted sets: sorted elements a with weights x, b with y."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = x[i].astype(np.float64), y[j].astype(np.float64)
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    ratio = p / q
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    from_x = np.append(np.cumsum(p[::-1])[::-1], 0.0)  # weights of x from each place on
    upto_y = np.insert(np.cumsum(q), 0, 0.0)
    cut = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / ((only_x + from_x[cut]) / p + (only_y + upto_y[cut]) / q)).sum())


def _chunks(texts: pa.Array) -> Iterator[slice]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for part in chunks(sizes):
        for start in range(part.start, part.stop, TEXTS_IN_CHUNK):
            yield slice(start, min(part.stop, start + TEXTS_IN_CHUNK))


def _banded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for part in _chunks(texts):
                n = part.stop - part.start
                text, shingle, count = weighted_shingles(texts.slice(part.start, n), size)
                keys = band_keys(signatures(text, shingle, count.astype(np.float64), n)).view(np.int64)
                has = np.isin(np.arange(n), text)
                at = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(part.start, n) for c in batch.columns[:-1]), lists], [*batch.schema.names[:-1], "bands"])

    return run


def _featured(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for part in _chunks(texts):
                n = part.stop - part.start
                text, shingle, count = weighted_shingles(texts.slice(part.start, n), size)
                registers = (signatures(text, shingle, count.astype(np.float64), n) & np.uint64(0xFFFF)).astype(np.uint16)
                at = np.searchsorted(text, np.arange(n + 1))
                blobs = [[part_of(i).tobytes() for i in range(n)] for part_of in (
                    lambda i: registers[i], lambda i: shingle[at[i]:at[i + 1]], lambda i: count[at[i]:at[i + 1]].astype(np.uint32))]
                columns = [c.slice(part.start, n) for c in batch.columns[:-1]] + [pa.array(b, pa.binary()) for b in blobs]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "registers", "shingles", "counts"])

    return run


def _links(registers: np.ndarray, side: np.ndarray, features, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between members that join two classes, best estimates first; pairs of one block only meet in its own turn."""
    n = len(registers)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    error = SLACK * np.sqrt(similarity * (1 - similarity) / REGISTERS)
    least = int((similarity - error) * REGISTERS)
    found = []
    for i in range(n - 1):
        agree = (registers[i + 1 :] == registers[i]).sum(axis=1)
        hit = np.flatnonzero((agree >= least) & (side[i + 1 :] != side[i] if side[0] != side[-1] else True))
        found.append(np.stack([agree[hit], np.full(len(hit), i), hit + i + 1], axis=1))
    pairs = np.concatenate([*found, np.zeros((0, 3), np.int64)])
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")]:
        if (a := root(i)) != (b := root(j)) and probability_jaccard(*features(i), *features(j)) >= similarity:
            parent[a] = b
            yield i, j


def _verified(similarity: float):
    """Splits sorted rows (arena, one, two, block, node, registers, shingles, counts) into groups and links each."""

    def linked(rows: list) -> pa.RecordBatch:
        node, registers, shingles, counts, block = (pa.concat_arrays([r[k] for r in rows]) for k in (4, 5, 6, 7, 3))
        order = np.argsort(block.to_numpy(), kind="stable")
        matrix = np.stack([np.frombuffer(registers[int(i)].as_buffer(), np.uint16) for i in order])
        features = lambda i: (np.frombuffer(shingles[int(order[i])].as_buffer(), np.uint64), np.frombuffer(counts[int(order[i])].as_buffer(), np.uint32))
        found = list(_links(matrix, block.to_numpy()[order], features, similarity))
        side = lambda k: pa.array([node[int(order[p[k]])].as_py() for p in found], pa.binary())
        return pa.RecordBatch.from_arrays([side(0), side(1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, stop in zip(edges[:-1], edges[1:]):
                if keys[start] != last and held:
                    yield linked(held)
                    held = []
                last = keys[start]
                held.append([c.slice(start, stop - start) for c in batch.columns])
        if held:
            yield linked(held)

    return run


def links(texts: DataFrame, *, similarity: float, size: int) -> DataFrame:
    """(a, b): links that join the distinct texts (node, text) into their classes."""
    banded = texts.mapInArrow(_banded(size), "node binary, bands array<long>")
    keys = cut_lineage(banded.select("node", F.explode("bands").alias("key")))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most")
    proposed = keys.join(hubs.select("key", "hub"), "key").where("node <> hub").select("hub", "node").distinct()
    arenas = cut_lineage(components(proposed, "hub", "node").withColumnRenamed("root", "arena"))
    sizes = arenas.groupBy("arena").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    members = texts.join(arenas, "node").select("arena", "node", "text")
    featured = members.mapInArrow(_featured(size), "arena binary, node binary, registers binary, shingles binary, counts binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = featured.join(sizes, "arena").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "arena", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block",
        "node", "registers", "shingles", "counts",
    )
    met = met.repartition("arena", "one", "two").sortWithinPartitions("arena", "one", "two")
    return met.mapInArrow(_verified(similarity), "a binary, b binary")


def classes(docs: DataFrame, *, text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(node, class): for every text with another in its class, the class's root; node identifies the text."""
    rows = docs.select(node_of(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # equal texts meet before anything is computed from them twice
    distinct = rows.groupBy("node").agg(F.first("text").alias("text"))
    found = cut_lineage(links(distinct, similarity=similarity, size=size))
    return components(found).select("node", F.col("root").alias("class"))


def class_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of the class), class_size, kept.

    A class is a connected component of texts with probability Jaccard similarity
    of word shingles (weight: count) at or above the threshold. Equal texts,
    null and empty ones among them as one text, are one class; a text of fewer
    words than a shingle counts as one shingle, texts without words only meet
    equal ones. ``kept`` marks one row of each class: smallest id, nulls last; of
    equal ids the first. Rows with the same id and text count each. Other columns
    are ignored; an empty table gives no rows.
    """
    found = cut_lineage(classes(docs, text=text, **options))
    rows = docs.select(F.col(id).alias(id), node_of(F.col(text)).alias("node"))
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    first = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("_row").alias("row")))
    # cut, so that both sides of the join are dealt for it alone and Spark can split a large class
    whole = cut_lineage(rows.groupBy("class").agg(first.alias("first"), F.count("*").alias("class_size")))
    return rows.join(whole, "class").select(
        id, F.col("first.id").alias("class_id"), "class_size", (F.col("_row") == F.col("first.row")).alias("kept")
    )


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row left of each class, see ``class_of_each``; columns unchanged."""
    found = cut_lineage(classes(docs, text=text, **options))
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), node_of(F.col(text)).alias("node"), F.col(id).alias("_id"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"))
    texts = whole.groupBy("node").agg(F.min_by("_doc", order).alias("_doc"), F.min("_id").alias("_id"))
    # equal texts are one row before they meet anything
    ids = docs.select(node_of(F.col(text)).alias("node"), F.col(id).alias("_id")).groupBy("node").agg(F.min("_id").alias("_id")).join(found, "node")
    stay = ids.groupBy("class").agg(F.min_by("node", F.struct(F.col("_id").isNull(), F.col("_id"), F.col("node"))).alias("stay"))
    gone = ids.join(stay, "class").where("node <> stay").select("node")
    return texts.join(gone, "node", "left_anti").select("_doc.*")
