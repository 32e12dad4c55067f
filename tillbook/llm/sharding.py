"""Sharding by jump consistent hashing.

A stable integer key and the number of shards decide the shard; no ring table
is kept. Appending a shard moves a key only into the new shard, and on average
one key in ``shards + 1`` moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.session import cut_lineage

# Fixed values of the published algorithm.
LCG_MULTIPLIER = 2862933555777941757
JUMP_RANGE = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; all keys jump together until each has left the range."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(LCG_MULTIPLIER) + np.uint64(1)
        step = JUMP_RANGE / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def shard_of(key, shards: int):
    """Column expression: shard of a long key; a null key is placed as key 0."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def gapless_slots(rows: DataFrame, shard: str, slot: str) -> DataFrame:
    """Adds the position of each row within its shard, from 0 without gaps.

    Rows are numbered inside each piece of the input; a short list with one
    count per (shard, piece) then gives every piece its first slot. No shard
    is ever gathered in one task.
    """
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_piece", F.shiftright("_row", 33))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.groupBy(shard, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(shard, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = F.row_number().over(Window.partitionBy(shard, "_piece").orderBy("_row")) - 1
    return (
        rows.withColumn("_inside", inside)
        .join(first, [shard, "_piece"])
        .withColumn(slot, (F.col("_first") + F.col("_inside")).cast("long"))
        .drop("_row", "_piece", "_first", "_inside")
    )


def shard_rows(df: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places every row of ``df``; one row out per row in.

    Columns: key, size, text_crc32, shard, grown_shard (with one shard more), slot.
    The key alone decides, so repeated rows and equal keys share a shard; a null
    key counts as key 0. A null text has size 8 and a null checksum. Other
    columns of ``df`` are left out, whatever their names. An empty table gives none.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = df.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.col(text), "UTF-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", shard_of(F.col(key), shards))
    rows = rows.withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    return gapless_slots(rows, "shard", "slot")
