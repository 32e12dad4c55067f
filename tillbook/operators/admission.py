"""Requests served one after the other while balances last, without walking a large key in one task.

A request draws on one or more keys at once and is taken as a whole or not at
all; a refused one leaves every balance as it was. Where every request has one
key, keys of up to ``ROWS_OF_KEY`` rows are served one by one, each by itself.

All others are settled in rounds. In a round, the balance that a request would
find has an upper bound (none of the earlier open requests is taken) and a lower
one (all are); both are running sums per key. A request that fits under all
lower bounds is taken, one that exceeds an upper bound is refused, and the
earliest open ones, whose bounds meet, are always decided. From the second round
on, a bounded number of the earliest open rows is also served one by one (of whole
requests only where rounds are slow or few rows are left), so that long chains of
doubtful requests don't make as many rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.running import Running, running_all
from tillbook.session import cut_lineage

# Rows served one by one: of every key at once, or of all keys where requests tie them together.
ROWS_OF_KEY = 10_000
ROWS_OF_ALL = 20_000

_AMOUNT = "decimal(20,2)"
# A round that leaves more than this share of the open rows is a slow one.
SLOW = 0.75


def _amount(*columns: T.DataType) -> str:
    """What amounts are reckoned in: whole numbers of up to 32 bits, whose sums fit, as such; all others in ``_AMOUNT``."""
    return "bigint" if all(isinstance(c, T.ByteType | T.ShortType | T.IntegerType) for c in columns) else _AMOUNT


def admit_in_order(
    requests: DataFrame,
    capacity: DataFrame,
    key: str,
    order: list[str],
    quantity: str,
    bucket: Column,
    capacity_col: str = "capacity",
) -> DataFrame:
    """Adds ``admitted``: each request is taken in order if it still fits, otherwise skipped.

    Exact for skipped requests too: a request that is refused uses nothing.
    Requests of 0 or less, and requests for a key without capacity row, are
    refused. ``order`` tells the requests of a key apart.
    """
    counted = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    long = cut_lineage(counted.where(F.col("_n") > ROWS_OF_KEY).select(key))
    if long.isEmpty():
        return _in_turn(requests, capacity, key, order, quantity, capacity_col)
    short = requests.join(long, key, "left_anti").select(*requests.columns)
    hot, need = requests.join(long, key, "left_semi").select(*requests.columns), F.col(quantity).cast(_AMOUNT)
    asked = hot.where(need > 0).select(key, *order, need.alias("_need"), (-need).alias("_delta"), bucket.alias("_span"))
    room = capacity.select(F.col(key), F.col(capacity_col).cast(_AMOUNT).alias("_base"))
    in_rounds = _with_decisions(hot, _settle(asked.join(room, key), key, order, None), key, order)
    return _in_turn(short, capacity, key, order, quantity, capacity_col).unionByName(in_rounds)


def _in_turn(
    requests: DataFrame, capacity: DataFrame, key: str, order: list[str], quantity: str, capacity_col: str
) -> DataFrame:
    """``admit_in_order`` for keys of few rows: one pass over the requests, each key's capacity coming before them.

    Requests are shuffled once, whole, and never joined with their decisions. Rows
    alike in key and order are one request, of the least quantity among them.
    """
    need, fields = F.col(quantity).cast(_AMOUNT), requests.schema.fields
    asked = requests.withColumns({"_need": F.when(need > 0, need), "_asks": F.lit(True)})
    # a key that can't be one of the requests' kind has none
    room = capacity.select(
        F.col(key).try_cast(requests.schema[key].dataType).alias(key), F.col(capacity_col).cast(_AMOUNT).alias("_room"),
        F.lit(False).alias("_asks")).where(F.col(key).isNotNull())
    # rows without a key are refused, wherever they are
    spread = F.when(F.col(key).isNull(), F.xxhash64(*order)).alias("_spread")
    both = asked.unionByName(room, allowMissingColumns=True).withColumn("_spread", spread).repartition(key, "_spread")
    turn = Window.partitionBy(key, "_spread").orderBy("_asks", F.col("_room").desc(), *order, F.col("_need").asc_nulls_last())
    name = F.struct("_asks", *order)
    marked = both.withColumns({"_first": F.lag("_asks").over(turn).isNull(), "_again": name.eqNullSafe(F.lag(name).over(turn))})
    own = [f.name for f in fields]
    held = marked.select(*own, "_asks", "_first", "_again", "_need", "_room")
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, ok = None, False
        for batch in batches:
            out = []
            for asks, first, again, need, room in zip(*[c.to_pylist() for c in batch.columns[n:]]):
                if first:
                    left = None if asks else room
                if not again:
                    ok = asks and left is not None and need is not None and need <= left
                    if ok:
                        left -= need
                out.append(ok)
            table = pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.bool_())], names=[*own, "admitted"])
            yield table.filter(batch.columns[n])

    kinds = [T.StructField(f.name, f.dataType) for f in fields]
    return held.mapInArrow(run, T.StructType([*kinds, T.StructField("admitted", T.BooleanType())]))


def admit_with_inflows(
    events: DataFrame,
    opening: DataFrame,
    key: str,
    order: list[str],
    delta: str,
    bucket: Column,
    opening_col: str = "opening",
) -> DataFrame:
    """Adds ``admitted`` to events that fill (delta >= 0) or draw on (delta < 0) a balance.

    Fillings always count; a drawing is taken only if the balance covers it at
    that moment, otherwise it changes nothing. Exact for any number of events
    and any opening balance, negative ones included. Events of a key without
    opening are left out. ``order`` tells the events of a key apart. There is at
    most one round for ``ROWS_OF_KEY`` drawings of the longest key, and two more.
    """
    change = F.col(delta).cast(_AMOUNT)
    base = opening.select(F.col(key), F.col(opening_col).cast(_AMOUNT).alias("_base"))
    known = events.join(base.select(key), key, "left_semi")
    rows = events.select(key, *order, F.when(change < 0, -change).alias("_need"), change.alias("_delta"), bucket.alias("_span"))
    return _with_decisions(known, _settle(rows.join(base, key), key, order, None), key, order, open_only=delta)


def admit_whole(
    lines: DataFrame,
    opening: DataFrame,
    request: str,
    key: str,
    order: list[str],
    delta: str,
    bucket: Column,
    opening_col: str = "opening",
) -> DataFrame:
    """(request, admitted): requests of several lines, each taken or refused as a whole, in ``order``.

    A line fills (delta >= 0) or draws on (delta < 0) the balance of its key. A
    request that only fills is always taken; another is taken if the balance of
    every key it draws on covers each of its lines there, as the shop checks
    them line by line; all lines then count together, so that lines of one key
    may take its balance below zero. Keys without opening have 0. ``order`` is
    the same in all lines of a request and ends with what tells requests apart.
    """
    kind = _amount(lines.schema[delta].dataType, opening.schema[opening_col].dataType)
    change = F.col(delta).cast(kind)
    each = lines.withColumns({"_change": change, "_span": bucket}).groupBy(request, key, *[c for c in order if c != request], "_span").agg(
        F.max(F.when(F.col("_change") < 0, -F.col("_change"))).alias("_need"), F.sum("_change").cast(kind).alias("_delta"))
    base = opening.select(F.col(key), F.col(opening_col).cast(kind).alias("_base"))
    rows = each.join(base, key, "left").withColumn("_base", F.coalesce("_base", F.lit(0).cast(kind)))
    fills = lines.groupBy(request).agg(F.bool_and(change >= 0).alias("_fills")).where("_fills").select(request, F.lit(True).alias("admitted"))
    return fills.unionByName(_settle(rows, key, order, request))


def _with_decisions(rows: DataFrame, decided: DataFrame, key: str, order: list[str], open_only: str | None = None) -> DataFrame:
    """``rows`` with ``admitted`` from the decisions; others are refused, or with ``open_only`` taken if they don't draw."""
    names = [key, *order]
    found = decided.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(names)], "admitted")
    same = [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(names)]
    other = F.lit(False) if open_only is None else F.coalesce(F.col(open_only) >= 0, F.lit(False))
    return rows.join(found, same, "left").withColumn("admitted", F.coalesce("admitted", other)).select(*rows.columns, "admitted")


def _settle(rows: DataFrame, key: str, order: list[str], request: str | None) -> DataFrame:
    """Decisions on the rows with a need: by (key, order), or by request.

    ``rows``: key, order, request, _span (bucket), _base (the key's balance), _need
    (null: always counts) and _delta. One row per key and request.
    """
    decisions: list[DataFrame] = []
    if request is None:
        long = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS_OF_KEY).select(key))
        decisions.append(_serve(rows.join(long, key, "left_anti").withColumn("_rows", F.lit(1).cast("bigint")), key, order, None))
        if long.isEmpty():
            return decisions[0]
        rows = rows.join(long, key, "left_semi")
    first = len(decisions)
    state = rows.withColumn("_open", F.col("_need").isNotNull())
    if request is not None:
        sizes = rows.groupBy(request).agg(F.count("*").alias("_rows"), F.count("_need").alias("_draws"))
        # lines that fill wait for the request's other lines
        state = cut_lineage(state.join(sizes, request).withColumn("_open", F.col("_draws") > 0).drop("_draws"))
        long = cut_lineage(state.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS_OF_KEY).select(key))
    whose = [key, *order] if request is None else [request]
    bounds = [
        Running("_sure", F.when(~F.col("_open"), F.col("_delta")).otherwise(0), inclusive=False),
        # of what is open, only the drawings lower what others find at the least, only the fillings raise it at the most
        Running("_least", F.when(F.col("_open"), F.least("_delta", F.lit(0))).otherwise(0), inclusive=False),
    ]
    if request is None:
        bounds.append(Running("_nth", F.when(F.col("_open"), 1).otherwise(0).cast("bigint"), inclusive=False))
    else:
        bounds.append(Running("_most", F.when(F.col("_open"), F.greatest("_delta", F.lit(0))).otherwise(0), inclusive=False))
    kind, opened = rows.schema["_base"].dataType, None
    while True:
        if request is not None:
            # keys of few rows are walked in one piece, others by spans
            pieces = [(state, None)] if long.isEmpty() else [
                (state.join(long, key, "left_anti"), None), (state.join(long, key, "left_semi"), F.col("_span"))]
        else:
            pieces = [(state, F.col("_span"))]
        walked = reduce(DataFrame.unionByName, [running_all(x, [key], order, bounds, span, null_keys=False) for x, span in pieces])
        walked = walked.where("_open").withColumn("_base", (F.col("_base") + F.col("_sure")).cast(kind))
        walked = cut_lineage(walked.drop("_sure", "_open"))
        before, opened = opened, walked.count()
        if not opened:
            break
        most = F.lit(0) if request is None else F.col("_most")
        fits, never = F.col("_need") <= F.col("_base") + F.col("_least"), F.col("_need") > F.col("_base") + most
        if request is None:
            judged = walked.withColumn("admitted", F.when(fits, True).when(never, False))
        else:
            verdict = walked.groupBy(request).agg(
                F.bool_and(F.coalesce(fits, F.lit(True))).alias("_fits"), F.bool_or(F.coalesce(never, F.lit(False))).alias("_never"))
            verdict = verdict.select(request, F.when(F.col("_fits"), True).when(F.col("_never"), False).alias("admitted"))
        # whole requests are tied to each other and served by one task, so only where rounds don't get on or few are left
        if len(decisions) > first and (request is None or opened <= ROWS_OF_ALL or opened > before * SLOW):
            # the earliest open rows: of every key, or whole requests of all keys
            some = walked.where(F.col("_nth") < ROWS_OF_KEY) if request is None else walked.orderBy(*order, key).limit(ROWS_OF_ALL)
            served = _serve(some.withColumn("_rows", F.lit(1).cast("bigint")) if request is None else some, key, order, request)
            names = [F.col(c).alias(f"_at{i}") for i, c in enumerate(whose)]
            same = [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(whose)]
            found = judged if request is None else verdict
            after = found.join(served.select(*names, F.col("admitted").alias("_served")), same, "left")
            after = after.withColumn("admitted", F.coalesce("_served", "admitted")).select(*found.columns)
            judged, verdict = (after, None) if request is None else (None, after)
        if request is not None:
            # one short row per request, written once: the next round and the result read it
            verdict = cut_lineage(verdict)
            judged = walked.join(verdict, request)
        judged = judged.drop("_least", "_most", "_nth")
        decided = judged if request is None else verdict
        decisions.append(decided.where("admitted is not null").select(*whose, "admitted"))
        # what was taken counts in the next round, what was refused is gone
        state = judged.where("admitted is null or admitted").withColumn("_open", F.col("admitted").isNull()).drop("admitted")
    if not decisions:  # nothing draws
        return rows.limit(0).select(*whose, F.lit(False).alias("admitted"))
    return reduce(DataFrame.unionByName, decisions)


def _serve(some: DataFrame, key: str, order: list[str], request: str | None) -> DataFrame:
    """Exact decisions on rows that hold all open ones up to a place, served one by one; requests cut off are left out."""
    names = [key, *order] if request is None else [request]
    if request is None:
        dealt = some.repartition(key).sortWithinPartitions(key, *order)
    else:
        dealt = some.repartition(1).sortWithinPartitions(*order, key)
    held = dealt.select(*names, "_need", "_delta", "_base", F.col(key).alias("_key"), "_rows")
    n = len(names)
    by_key = request is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what was taken of a key here; _base counts all that was decided before
        moved: dict = {}
        open_rows: list = []
        current = key_now = None

        def serve():
            nonlocal moved
            ok = all(need is None or need <= base + moved.get(k, 0) for k, need, _, base in open_rows)
            if ok:
                for k, _, delta, _ in open_rows:
                    moved[k] = moved.get(k, 0) + delta
            return ok

        for batch in batches:
            schema = pa.schema([*[batch.schema.field(i) for i in range(n)], pa.field("admitted", pa.bool_())])
            values = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for row in zip(*values):
                name, (need, delta, base, k, size) = row[:n], row[n:]
                if name != current:
                    open_rows = []
                    current = name
                    if by_key and k != key_now:
                        moved, key_now = {}, k
                open_rows.append((k, need, delta, base))
                if len(open_rows) == size:
                    out.append((*name, serve()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * (n + 1), schema)], schema=schema)

    fields = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in names)
    return held.mapInArrow(run, f"{fields}, admitted boolean")
