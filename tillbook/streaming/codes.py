"""One-time codes as keyed state: requested, checked, expired."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillbook.streaming.runner import BUCKETS, run_closing

# Lifetime of a code, pause between requests, tries per code.
TTL_SECONDS, COOLDOWN_SECONDS, MAX_ATTEMPTS = 600, 60, 5

OUTPUT = "identifier bigint, purpose string, event_id bigint, outcome string"
STATE = "created_at bigint, expires_at bigint, attempts int"
KEEP_SECONDS = 86_400
KEYS = ["identifier", "purpose"]
# What a row of the followed table holds of a code.
_CODE = {"created_at": "bigint", "expires_at": "bigint", "attempts": "int"}


def code_outcomes(
    events: DataFrame,
    ttl: int = TTL_SECONDS,
    cooldown: int = COOLDOWN_SECONDS,
    attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Outcome of every request and check of a code.

    Input: identifier, purpose, event_id, ts (watermarked), kind (``request``
    or ``check``) and correct. A request within the pause is ``refused``, else
    it replaces the code (``sent``). A check finds ``none``, ``expired`` or
    ``too many`` (both drop the code), ``wrong`` or ``ok`` (drops it). Codes
    nobody asks about are dropped a day after they expire. The state of a key
    is three numbers; events of a micro-batch are taken in time order.
    """

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        code = state.get if state.exists else None
        ids, outcomes = [], []
        for event_id, ts, kind, correct in zip(rows["event_id"], rows["ts"], rows["kind"], rows["correct"]):
            code, outcome = _step(code, int(pd.Timestamp(ts).timestamp()), kind, bool(correct), ttl, cooldown, attempts)
            ids.append(event_id)
            outcomes.append(outcome)
        if code is None:
            if state.exists:
                state.remove()
        else:
            state.update(code)
            due = (code[1] + KEEP_SECONDS) * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame(
            {"identifier": key[0], "purpose": key[1], "event_id": ids, "outcome": outcomes}
        )

    return events.groupBy("identifier", "purpose").applyInPandasWithState(
        advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def _step(code, now: int, kind: str, correct: bool, ttl: int, cooldown: int, attempts: int):
    """The code after an event, and the event's outcome."""
    if kind == "request":
        if code is not None and now - code[0] < cooldown:
            return code, "refused"
        return (now, now + ttl, 0), "sent"
    if code is None:
        return None, "none"
    created, expires, tried = code
    if expires < now:
        return None, "expired"
    if tried >= attempts:
        return None, "too many"
    if not correct:
        return (created, expires, tried + 1), "wrong"
    return None, "ok"


def follow_codes(
    events: DataFrame,
    ttl: int = TTL_SECONDS,
    cooldown: int = COOLDOWN_SECONDS,
    attempts: int = MAX_ATTEMPTS,
    folder: str | None = None,
    buckets: int = BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """(codes still held, outcome of every event), by the rules of ``code_outcomes``.

    Runs the stream over what is there; codes are rows of a merged table, and a
    micro-batch writes only the buckets that it touches. Spark sorts the events
    of a micro-batch by key and time, spilling if it must, and a task reads them
    in that order, one Arrow batch after the other: a key may have any number of
    events. A code goes ``KEEP_SECONDS`` after it expires by the newest event of
    the batch that next touches its bucket. Null keys are keys like others, a
    null ``correct`` is false, events without a time have no outcome.
    """
    none = {name: F.lit(None).cast(kind) for name, kind in {"outcome": "string", **_CODE}.items()}
    stream = events.where("ts is not null").select(
        *KEYS, F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "kind", F.coalesce("correct", F.lit(False)).alias("correct"), *[c.alias(name) for name, c in none.items()],
    )

    def walked(rows: DataFrame) -> DataFrame:
        newest = rows.where("_batch").agg(F.max("at")).first()[0]
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        in_order = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "_batch", "at", "event_id")
        return in_order.mapInArrow(
            lambda batches: _walk(batches, newest // 1_000_000 - KEEP_SECONDS, ttl, cooldown, attempts), nullable
        )

    held, left = run_closing(stream, KEYS, walked, F.col("outcome").isNotNull(), folder, buckets)
    return held.select(*KEYS, *_CODE), left.select(*KEYS, "event_id", "outcome")


def _walk(
    batches: Iterator[pa.RecordBatch], oldest: int, ttl: int, cooldown: int, attempts: int
) -> Iterator[pa.RecordBatch]:
    """Events in order of key and time, the code held before first; gives them with outcomes and the codes held after.

    Codes that expired before ``oldest`` are left out.
    """
    key = code = schema = last = None

    def held() -> list[dict]:
        if code is None or code[1] < oldest:
            return []
        empty = dict.fromkeys(schema.names)
        return [{**empty, **last, **dict(zip(_CODE, code)), "correct": False, "_batch": True}]

    for batch in batches:
        schema, out = batch.schema, []
        for row in batch.to_pylist():
            own = tuple(row[k] for k in KEYS)
            if own != key:
                out += held()
                key, code, last = own, None, {k: row[k] for k in [*KEYS, "_bucket"]}
            if row["_batch"]:
                code, row["outcome"] = _step(code, row["at"] // 1_000_000, row["kind"], row["correct"], ttl, cooldown, attempts)
                out.append(row)
            else:
                code = tuple(row[name] for name in _CODE)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if schema is not None:
        yield pa.RecordBatch.from_pylist(held(), schema=schema)
