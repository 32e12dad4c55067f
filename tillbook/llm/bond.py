"""Hard negatives by a vertical scan of columnar blocks (BOND).

Rows are dealt into blocks that keep each dimension as a column, with its least
and greatest component. An anchor reads a block's columns in descending order
of its own components' magnitude, a few at a time. What is read is a partial
score of every candidate; the columns not yet read can add no less and no more
than their extremes times the anchor's components. Of the candidates only those
stay whose bounds still reach into a wanted window of scores and, where as many
rows as wanted are sure to be in it, up to the last of these. Those left when all
columns are read have exact scores.

Positives are the best in a window without ends among rows of the anchor's
label; negatives the best in a window below each positive's score among others.
Both are searched in a few of the blocks first; what is found there is a safe
cutoff for all others, so that few rows leave a block.

A block is sent once for ``CHUNKS_TOGETHER`` chunks of anchors, and the chunks,
a small part of the rows, come to it one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.session import cut_lineage

ROWS_IN_BLOCK = 4096
ANCHORS_IN_CHUNK = 256
CHUNKS_TOGETHER = 64
MOST_TASKS = 50_000
# Sums below it are exact in double arithmetic; blocks that can exceed it are scored in whole numbers of any size.
EXACT = float(1 << 53)
# Parts in which the columns are read.
READS = 8

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_WINDOWS = "array<struct<w int, lo long, hi long>>"
_FOUND = "anchor_id long, w int, vec_id long, score long"
_BLOCK = "number int, dim int, ids array<long>, labels array<long>, data binary"


class Block:
    """Columns of one block's vectors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)
        self.most = float(np.abs(columns).max(initial=0.0))
        self._whole: Block | None = None

    def whole(self) -> Block:
        """The same in whole numbers of any size."""
        if self._whole is None:
            self._whole = Block.__new__(Block)
            self._whole.ids, self._whole.labels, self._whole.columns = self.ids, self.labels, _whole(self.columns)
            self._whole.low, self._whole.high = _whole(self.low), _whole(self.high)
        return self._whole


def _whole(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def resolve(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lo, hi) the ids and scores of the k best allowed rows within it, ties to the smaller id."""
    d = len(anchor)
    if float(np.abs(anchor).max(initial=0.0)) * block.most * max(1, d) >= EXACT:
        block, anchor = block.whole(), _whole(anchor)
    order = np.argsort([-abs(x) for x in anchor], kind="stable") if anchor.dtype == object else np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor[order] * block.low[order], anchor[order] * block.high[order]
    # least and most that columns from a place on can add
    add_low = np.append(np.cumsum(np.minimum(*ends)[::-1])[::-1], 0)
    add_high = np.append(np.cumsum(np.maximum(*ends)[::-1])[::-1], 0)
    alive = np.flatnonzero(allowed)
    partial = np.zeros(len(alive), anchor.dtype)
    step = max(1, -(-d // READS))
    for at in range(0, d, step):
        if not len(alive):
            break
        dims = order[at : at + step]
        partial = partial + anchor[dims] @ block.columns[dims[:, None], alive]
        to = min(d, at + step)
        lower, upper = partial + add_low[to], partial + add_high[to]
        keep = np.zeros(len(alive), bool)
        for lo, hi in windows:
            floor = lo
            sure = lower[(lower >= lo) & (upper <= hi)]
            if len(sure) >= k:
                floor = max(lo, np.sort(sure)[-k] if sure.dtype == object else np.partition(sure, len(sure) - k)[-k])
            keep |= ((upper >= floor) & (lower <= hi)).astype(bool)
        alive, partial = alive[keep], partial[keep]
    out = []
    for lo, hi in windows:
        inside = ((partial >= lo) & (partial <= hi)).astype(bool)
        ids, scores = block.ids[alive[inside]], partial[inside]
        best = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int) if len(ids) <= 64 else _best(ids, scores, k)
        out.append((ids[best], scores[best]))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    scores = -scores
    cut = np.sort(scores)[k - 1] if scores.dtype == object else np.partition(scores, k - 1)[k - 1]
    at = np.flatnonzero(scores <= cut)
    return np.array(sorted(at, key=lambda i: (scores[i], ids[i]))[:k], int)


# --- over a table -----------------------------------------------------------


def valid_rows(df: DataFrame, *, id: str, vector: str, label: str | None) -> DataFrame:
    """(vec_id, label, vec, _row) of the rows that take part."""
    tag = F.lit(0).cast("long") if label is None else F.col(label).cast("long")
    rows = df.select(F.col(id).cast("long").alias("vec_id"), tag.alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~bad)
    return rows.withColumn("_row", F.monotonically_increasing_id())


def _pack(rows: DataFrame, number, scale: int, columnar: bool, windows: bool = False) -> DataFrame:
    """One row per number and vector length, with ids, labels and the matrix of floor(scale * x), by column or by row."""
    fields = ["vec_id", "label", "vec", *(["windows"] if windows else [])]
    packed = rows.groupBy(number.cast("int").alias("number")).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    names = ["number", "dim", "ids", "labels", "data", *(["windows"] if windows else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, own = batch.column(0).slice(i, 1), batch.column(1)[i].values
                ids, labels, vectors = (own.field(j) for j in range(3))
                lengths = pa.compute.list_value_length(vectors)
                for dim in pa.compute.unique(lengths).to_pylist():
                    at = pa.compute.equal(lengths, dim)
                    some = vectors.filter(at)
                    matrix = np.floor(some.flatten().to_numpy(zero_copy_only=False) * float(scale)).reshape(len(some), dim)
                    data = np.ascontiguousarray(matrix.T if columnar else matrix).tobytes()
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    columns = [number, pa.array([dim], pa.int32()), one(ids.filter(at)), one(labels.filter(at)), pa.array([data], pa.binary())]
                    if windows:
                        columns.append(one(own.field(3).filter(at)))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return packed.mapInArrow(run, _BLOCK + (f", windows array<{_WINDOWS}>" if windows else ""))


def _scan(blocks: DataFrame, anchors: DataFrame, n_blocks: int, some, same: bool, k: int, scale: int, n_chunks: int) -> DataFrame:
    """(anchor_id, w, vec_id, score): per block the k best rows of every anchor and window.

    ``some``: condition on the number of a block. ``same``: rows of the anchor's label, else those of others.
    """
    chunks = _pack(anchors, F.pmod(F.xxhash64("_row"), F.lit(n_chunks)), scale, False, windows=True)
    lane = (F.col("number") / CHUNKS_TOGETHER).cast("int")
    no_windows = F.lit(None).cast(f"array<{_WINDOWS}>")
    last_lane = (n_chunks - 1) // CHUNKS_TOGETHER
    held = blocks.where(some(F.col("number"))).select(
        F.col("number").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(last_lane))).alias("lane"), F.lit(0).alias("kind"), "*",
        no_windows.alias("windows"))
    all_blocks = F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), some)
    come = chunks.select(F.explode(all_blocks).alias("block"), lane.alias("lane"), F.lit(1).alias("kind"), "*")
    # small in bytes, long in work: as many tasks as there are blocks to hold
    tasks = min(MOST_TASKS, n_blocks * (last_lane + 1))
    stream = held.unionByName(come).repartition(tasks, "block", "lane").sortWithinPartitions("block", "lane", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns)}
                dim = row["dim"].as_py()
                ids, labels = (row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                matrix = np.frombuffer(row["data"].as_buffer(), np.float64)
                if place != (key := (row["block"].as_py(), row["lane"].as_py())):
                    place, own = key, {}
                if row["kind"].as_py() == 0:
                    own[dim] = Block(ids, labels, matrix.reshape(dim, len(ids)).copy())
                    continue
                block = own.get(dim)
                if block is None:
                    continue
                found: list[tuple] = []
                for anchor_id, label, anchor, windows in zip(ids, labels, matrix.reshape(len(ids), dim), row["windows"].as_py()):
                    allowed = ((block.labels == label) == same) & (block.ids != anchor_id)
                    bounds = [(w["lo"], w["hi"]) for w in windows]
                    for w, (others, scores) in zip(windows, resolve(block, anchor, allowed, bounds, k)):
                        found += [(int(anchor_id), w["w"], int(o), max(_LEAST, min(_MOST, int(s)))) for o, s in zip(others, scores)]
                names, types = ("anchor_id", "w", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return stream.mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every anchor and window, ranked."""
    by_score = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _search(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_chunks: int, same: bool, k: int, scale: int) -> DataFrame:
    """The k best rows of every anchor and window over all blocks; ``anchors`` has windows."""
    stride = math.isqrt(n_blocks - 1) + 1
    scan = lambda who, some: _scan(blocks, who, n_blocks, some, same, k, scale, n_chunks)
    found = cut_lineage(_first(scan(anchors, lambda b: b % stride == 0), k))
    if stride > 1:
        # with k found, nothing below the last of them is wanted elsewhere
        cutoffs = found.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("cutoffs"))
        raised = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], F.col("cutoffs")[w["w"]]).alias("lo"), w["hi"].alias("hi")))
        narrow = anchors.join(cutoffs, anchors["vec_id"] == cutoffs["anchor_id"], "left").withColumn("windows", raised).drop("anchor_id", "cutoffs")
        found = _first(found.drop("rank").unionByName(scan(narrow, lambda b: b % stride != 0)), k)
    return found


def hard_negatives(
    df: DataFrame, is_anchor, *, positives: int = 5, negatives: int = 5, from_percent: int = 80, scale: int = 256,
    id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a function from the id column to a condition. A score is the
    inner product of floor(scale * x); higher ones come first, ties by smaller
    id. An anchor's positives are its first other rows of the same label, each
    positive's negatives the first rows of other labels whose score is between
    ``from_percent`` per cent of the positive's and the positive's own.

    Rows without an id or label, with a null vector or with null or non-finite
    components take no part; vectors meet those of the same length only. Every
    row of a repeated id is a candidate of all other ids, and a repeated anchor
    has the first of all its rows' pairs. Scores beyond a long count as its
    ends. Columns of other names are ignored. No anchors, one label only or an
    empty table give no rows.
    """
    # numbered once, as blocks and anchors must agree
    rows = cut_lineage(valid_rows(df, id=id, vector=vector, label=label))
    counted = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor(F.col("vec_id"))).alias("q")).first()
    n_blocks, n_chunks = max(1, -(-counted["n"] // ROWS_IN_BLOCK)), max(1, -(-counted["q"] // ANCHORS_IN_CHUNK))
    blocks = cut_lineage(_pack(rows, F.pmod(F.xxhash64("_row"), F.lit(n_blocks)), scale, True))
    anchors = rows.where(is_anchor(F.col("vec_id")))
    window = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    whole = F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST)))
    first = cut_lineage(_search(blocks, anchors.withColumn("windows", whole), n_blocks, n_chunks, True, positives, scale).drop("w"))

    score = F.col("score").cast("decimal(38,0)")
    least = F.ceil(score * from_percent / 100)
    wanted = first.where(least <= score).groupBy("anchor_id").agg(F.collect_list(window(F.col("rank"), least, F.col("score"))).alias("windows"))
    with_windows = anchors.join(wanted, anchors["vec_id"] == wanted["anchor_id"]).drop("anchor_id")
    others = _search(blocks, with_windows, n_blocks, n_chunks, False, negatives, scale)
    chosen = first.select("anchor_id", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return others.join(chosen, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
