"""Exact top-k inner products by a three-phase uniform threshold.

The components are dealt to ``LISTS`` lists; a list's local score of a row is
the inner product over its own components, and the score is the sum over lists.

1. Every block of rows names, for each list, the rows with the largest norms in
   it. These alone meet the queries; they give local score lists and from them
   whole scores. The k-th best is a safe cutoff: no row below it can be among
   the k best.
2. The cutoff goes to the blocks with the queries. By the largest norms of a
   block and list, no row of it can score more than the sum over lists of both
   norms' products; a block meets only query blocks that can reach a cutoff. A
   row whose score reaches the cutoff has a local score of at least
   cutoff / lists in some list, so only rows with such an entry are collected.
3. Their remaining local scores are resolved exactly, what falls below the
   cutoff goes, and the k best over all blocks are kept.

Rows are dealt to blocks by bands of their norm, so that the bounds are tight;
every block has a bounded number of rows, and no more than k rows leave it per
query. A block of rows is shuffled once, the queries go to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LISTS = 4
ROWS_IN_BLOCK = 4096
QUERIES_IN_BLOCK = 512
# Rows per block and list that phase 1 sees.
LEADERS = 32
# Bands of norms per doubling.
BANDS = 4
# The bounds are in doubles; a block is left out only if it misses by more than rounding.
ROUNDING = 1e-9
MOST_TASKS = 20_000
# Sums below it are exact in double arithmetic.
EXACT = float(1 << 53)

_PAIRS = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, *, id: str, vector: str, scale: int, every_row: bool) -> DataFrame:
    """(vec_id, vec, _row): components floor(scale * x) as long; rows that take no part are gone."""
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(~bad)
    rows = rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("vec"))
    if every_row:  # the number deals the rows of one id to several blocks
        return rows.withColumn("_row", F.monotonically_increasing_id())
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("_row", F.lit(0))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all queries with all rows."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _edges(dim: int) -> list[tuple[int, int]]:
    """The components of every list: from, to."""
    return [(dim * i // LISTS, dim * (i + 1) // LISTS) for i in range(LISTS)]


def _local(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The local scores of every list."""
    return [_products(queries[:, a:b], rows[:, a:b]) for a, b in _edges(queries.shape[1])]


def _norms(dim: int) -> list:
    """Columns with the norm of a vector in every list."""
    def of(a: int, b: int):
        return F.sqrt(F.aggregate(F.slice("vec", a + 1, b - a), F.lit(0.0), lambda s, x: s + x.cast("double") * x))

    return [of(a, b) for a, b in _edges(dim)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def leaders(qids, queries, ids, rows, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phase 1 of one block: per query the k best of its leading rows, with whole scores."""
    whole = sum(_local(queries, rows))
    for i, qid in enumerate(qids):
        at = np.flatnonzero(ids != qid)
        at = at[_best(whole[i, at], ids[at], k)]
        yield qid, ids[at], whole[i, at]


def _leading(rows: np.ndarray) -> np.ndarray:
    """Positions of the rows of a block that have the largest norms in some list."""
    some = min(LEADERS, len(rows))
    squares = [(rows[:, a:b].astype(np.float64) ** 2).sum(axis=1) for a, b in _edges(rows.shape[1])]
    return np.unique(np.concatenate([np.argpartition(-s, some - 1)[:some] for s in squares]))


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block cut to its leading rows."""
    for batch in batches:
        numbers, ids, vecs = (batch.column(name) for name in ("_rb", "_rb_vec_id", "_rb_vec"))
        for i in range(batch.num_rows):
            at = pa.array(_leading(_matrix(vecs, i)))
            kept = [pa.array([col[i].values.take(at)], col.type) for col in (ids, vecs)]
            yield pa.RecordBatch.from_arrays([numbers.slice(i, 1), *kept], ["_rb", "_rb_vec_id", "_rb_vec"])


def survivors(qids, queries, cutoffs, ids, rows, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phases 2 and 3 of one block: rows with an entry of at least cutoff / lists, resolved."""
    local = _local(queries, rows)
    share = cutoffs[:, None] / LISTS
    seen = np.zeros((len(qids), len(ids)), bool)
    for part in local:
        seen |= part >= share
    whole = sum(local)
    seen &= (whole >= cutoffs[:, None]) & (ids[None, :] != qids[:, None])
    for i, qid in enumerate(qids):
        at = np.flatnonzero(seen[i])
        at = at[_best(whole[i, at], ids[at], k)]
        yield qid, ids[at], whole[i, at]


def _packed(rows: DataFrame, block: str, columns: list[str]) -> DataFrame:
    """One row per block, its columns as lists of equal length."""
    return rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows")).select(
        block, *[F.col(f"_rows.{c}").alias(f"{block}_{c}") for c in columns]
    )


def _met(pairs: DataFrame, queries: DataFrame, rows: DataFrame, tasks: int) -> DataFrame:
    """The blocks of every pair (_qb, _rb); queries are copied to the row blocks, rows move once."""
    sent = pairs.join(queries, "_qb").repartition(tasks, "_rb")
    return sent.join(rows.repartition(tasks, "_rb").hint("merge"), "_rb")


def _matrix(lists: pa.Array, i: int) -> np.ndarray:
    own = lists[i].values
    flat = own.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(own), -1)


def _emit(kind, k: int):
    """mapInArrow function that applies one of the phases to each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                flat = lambda name: col[name][i].values.to_numpy(zero_copy_only=False)
                qids, ids = flat("_qb_vec_id"), flat("_rb_vec_id")
                queries, rows = _matrix(col["_qb_vec"], i), _matrix(col["_rb_vec"], i)
                extra = (flat("_qb_cutoff"),) if "_qb_cutoff" in col else ()
                found = list(kind(qids, queries, *extra, ids, rows, k))
                counts = [len(x[1]) for x in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([x[0] for x in found], counts).astype(np.int64)),
                    pa.array(np.concatenate([x[1] for x in found]).astype(np.int64)),
                    pa.array(np.concatenate([x[2] for x in found]).astype(np.int64)),
                ], ["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query, k: int, *, id: str = "vec_id", vector: str = "embedding", scale: int = 64, every_row: bool = False) -> DataFrame:
    """The k best rows of every query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a function from the id column to a condition. Score: inner
    product of floor(scale * x). Ties go to the smaller id; fewer than k other
    rows give them all. Rows without an id, with a null vector or with null or
    non-finite components take no part. Repeated ids count once, with the
    smallest vector; with ``every_row`` each row is a candidate of all other ids,
    and a repeated query id has the k best of all its rows' pairs. Vectors are compared with those of the same length only.
    Columns of other names are ignored. No queries or an empty table give no rows.
    Scores and their sums must fit 64 bits; larger ones wrap.
    """
    vectors = integer_vectors(df, id=id, vector=vector, scale=scale, every_row=every_row).withColumn("_dim", F.size("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    vectors = vectors.withColumn("_band", F.floor(F.log2(1 + F.sqrt(square)) * BANDS).cast("int"))
    wanted = is_query(F.col("vec_id"))
    sizes: dict[int, dict[int, tuple[int, int]]] = {}
    counted = vectors.groupBy("_dim", "_band").agg(F.count("*").alias("n"), F.count_if(wanted).alias("q"))
    for s in counted.collect():  # a few hundred bands per length
        sizes.setdefault(s["_dim"], {})[s["_band"]] = (s["n"], s["q"])
    parts = [
        _top_k_of(vectors.where(F.col("_dim") == dim), wanted, k, dim, bands)
        for dim, bands in sorted(sizes.items()) if any(q for _, q in bands.values())
    ]
    if not parts:
        spark = df.sparkSession
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if every_row and len(parts) > 1:  # rows of one id may differ in length
        best = out.withColumn("rank", F.row_number().over(_by_score()))
        out = best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out


def _by_score():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def _top_k_of(vectors: DataFrame, wanted, k: int, dim: int, bands: dict[int, tuple[int, int]]) -> DataFrame:
    n_query = math.ceil(sum(q for _, q in bands.values()) / QUERIES_IN_BLOCK)
    first, n_row = {}, 0
    for band, (n, _) in sorted(bands.items()):
        first[band] = (n_row, math.ceil(n / ROWS_IN_BLOCK))
        n_row += first[band][1]
    of_band = [F.create_map(*[F.lit(x) for band, at in first.items() for x in (band, at[i])])[F.col("_band")] for i in (0, 1)]
    block = (of_band[0] + F.pmod(F.xxhash64("vec_id", "_row"), of_band[1])).cast("int")
    normed = vectors.withColumn("_norms", F.array(*_norms(dim)))
    dealt = normed.withColumn("_rb", block)
    rows = _packed(dealt, "_rb", ["vec_id", "vec"])
    queries = normed.where(wanted).withColumn("_qb", F.pmod(F.xxhash64("vec_id", "_row", F.lit(1)), F.lit(n_query)).cast("int"))
    by_score = _by_score()
    tasks = min(2 * n_row, MOST_TASKS)
    every = queries.select("_qb").distinct().withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(n_row - 1))))

    heads = rows.mapInArrow(_lead, rows.schema)
    seen = _met(every, _packed(queries, "_qb", ["vec_id", "vec"]), heads, tasks).mapInArrow(_emit(leaders, k), _PAIRS)
    cutoff = (
        seen.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff"))
    )
    # fewer than k others: everything is collected
    cut = queries.join(cutoff, "vec_id", "left").fillna({"cutoff": float("-inf")})
    pairs = _reachable(cut, dealt, n_row)
    second = _met(pairs, _packed(cut, "_qb", ["vec_id", "vec", "cutoff"]), rows, tasks).mapInArrow(_emit(survivors, k), _PAIRS)
    return (
        second.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _reachable(queries: DataFrame, rows: DataFrame, n_row: int) -> DataFrame:
    """Pairs of blocks (_qb, _rb) in which some row may reach some query's cutoff.

    A query reaches its cutoff only if the sum over lists of its norm times the
    block's largest norm does; each query block keeps its largest norms as
    shares of cutoff / lists.
    """
    def largest(df: DataFrame, block: str, name: str, share) -> DataFrame:
        return df.groupBy(block).agg(F.array(*[F.max(share(F.col("_norms")[i])) for i in range(LISTS)]).alias(name))

    asked = largest(
        queries, "_qb", "_shares",
        lambda norm: F.when(F.col("cutoff") > 0, norm * LISTS / F.col("cutoff")).otherwise(F.lit(float("inf"))),
    ).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(n_row - 1))))
    held = largest(rows, "_rb", "_most", lambda norm: norm)
    both = F.zip_with("_shares", "_most", lambda share, most: share * most)
    reach = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)  # infinity times nothing is NaN, which is above all
    return asked.join(held, "_rb").where(reach >= LISTS * (1 - ROUNDING)).select("_qb", "_rb")
