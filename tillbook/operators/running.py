"""Running aggregates that do not put a whole key into one task."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.session import cut_lineage

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


class Running(NamedTuple):
    """One running column: its name, the value, how it combines, and whether it counts the row itself."""

    out: str
    value: Column
    how: str = "sum"
    inclusive: bool = True


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    bucket: Column | None = None,
    how: str = "sum",
    inclusive: bool = True,
    null_keys: bool = True,
) -> DataFrame:
    """Running ``how`` of ``value`` per key in the given order; see ``running_all``."""
    return running_all(df, keys, order, [Running(out, value, how, inclusive)], bucket, null_keys)


def running_all(
    df: DataFrame, keys: list[str], order: list[str], columns: list[Running], bucket: Column | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """Adds running columns per key in the given order; rows equal in it go by their other columns.

    ``bucket`` must grow with the order (a day or month of the leading
    timestamp, a range of the leading id). Rows are windowed within their
    (key, bucket) only; the last row of each has the bucket's result, and the
    short list of these is accumulated per key and joined back. So a key holding
    a large share of all rows is spread over its buckets instead of landing in
    one task. Rows with a null in their key run within their bucket only, or are
    left out without ``null_keys``. The exclusive form yields null before the
    first row (0 for a sum).

    With keys this only adds to the plan: rows and bucket results need the same
    columns, so both read one exchange, and filters on the keys reach the input.
    Without keys, buckets are sampled ranges of the order, as many as there are
    shuffle partitions; these are written once, and ``bucket`` is not used.

    With keys but no ``bucket`` a key is walked in one piece, which costs a third of
    that: for keys known to have few rows. Rows with a null in their key then make one.
    """
    n = range(len(columns))
    if keys and bucket is None:
        return _in_one_piece(df, keys, order, columns, null_keys)
    spread = df.withColumns({f"_value{i}": columns[i].value for i in n})
    if keys:
        spread = spread.withColumn("_bucket", bucket)
        keyed = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        without, spread = spread.where(~keyed), spread.where(keyed)
    else:
        spread = cut_lineage(spread.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()))
    part_keys = [*keys, "_bucket"]
    rest = [f.name for f in spread.schema.fields if f.name not in (*part_keys, *order) and not _has_map(f.dataType)]

    # the order is made total, so that both readings of it agree
    ordered = Window.partitionBy(*part_keys).orderBy(*order, *rest)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_last": F.lead(F.lit(True)).over(ordered).isNull()}
    for i, c in enumerate(columns):
        local[f"_part{i}"] = _COMBINE[c.how](f"_value{i}").over(upto)
        if not c.inclusive:
            local[f"_local{i}"] = _COMBINE[c.how](f"_value{i}").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    walked = spread.withColumns(local)

    before = Window.partitionBy(*[f"_key{j}" for j in range(len(keys))]).orderBy(f"_key{len(keys)}")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = walked.where("_last").select(
        *[F.col(k).alias(f"_key{j}") for j, k in enumerate(part_keys)], *[F.col(f"_part{i}").alias(f"_total{i}") for i in n]
    )
    carried = totals.withColumns({f"_carried{i}": _COMBINE[columns[i].how](f"_total{i}").over(before) for i in n})
    same = [F.col(k) == F.col(f"_key{j}") for j, k in enumerate(part_keys)]
    joined = walked.join(carried.drop(*[f"_total{i}" for i in n]), same, "left")

    if keys and null_keys:
        joined = joined.unionByName(without.withColumns(local), allowMissingColumns=True)

    results = {}
    for i, c in enumerate(columns):
        here, earlier = F.col(f"_part{i}" if c.inclusive else f"_local{i}"), F.col(f"_carried{i}")
        if c.how == "sum":
            results[c.out] = F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            results[c.out] = (F.greatest if c.how == "max" else F.least)(earlier, here)
    return joined.withColumns(results).drop(
        "_bucket", "_last", *[f"_key{j}" for j in range(len(part_keys))],
        *[f"{name}{i}" for name in ("_value", "_part", "_local", "_carried") for i in n],
    )


def _in_one_piece(df: DataFrame, keys: list[str], order: list[str], columns: list[Running], null_keys: bool) -> DataFrame:
    rest = [f.name for f in df.schema.fields if f.name not in (*keys, *order) and not _has_map(f.dataType)]
    ordered = Window.partitionBy(*keys).orderBy(*order, *rest)
    results = {}
    for c in columns:
        walked = _COMBINE[c.how](c.value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow if c.inclusive else -1))
        results[c.out] = F.coalesce(walked, F.lit(0)) if c.how == "sum" else walked
    rows = df if null_keys else df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    return rows.withColumns(results)


def _has_map(kind: T.DataType) -> bool:
    """Maps can't be ordered."""
    return "map<" in kind.simpleString()


def position(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None) -> DataFrame:
    """1-based position of a row within its key."""
    return running(df, keys, order, F.lit(1).cast("bigint"), out, bucket)
