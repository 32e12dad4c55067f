"""Requests refused while the last accepted one is too recent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators.running import running
from tillbook.session import cut_lineage

DAY_SECONDS = 86_400


def accepted_requests(
    events: DataFrame, keys: list[str], ts: str, id_col: str, seconds: int = 60
) -> DataFrame:
    """The accepted requests per key: (keys, second, id of the first request in it).

    Acceptance times have second precision, so requests are first reduced to
    one row per key and second; however many requests a hot key sends, at most
    one row per second is left. A request with no other in the ``seconds``
    before it is accepted whatever came earlier. From an accepted request the
    next one is the first at least ``seconds`` later, so every request points
    to its successor, and the accepted ones are found by following pointers of
    doubling length: the rounds grow with the logarithm of the longest chain,
    each is a join on (keys, second), and no key is walked in one task. Keys
    must not be null.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    second = F.timestamp_diff("SECOND", epoch, F.col(ts).cast("timestamp_ntz"))
    seen = events.groupBy(*keys, second.alias("second")).agg(
        F.min_by(id_col, F.struct(ts, id_col)).alias(id_col)
    )
    rows = running(
        seen, keys, ["second"], F.col("second"), "_before",
        F.floor(F.col("second") / DAY_SECONDS), how="max", inclusive=False, null_keys=False,
    )
    free = F.col("_before").isNull() | (F.col("second") - F.col("_before") >= seconds)
    rows = cut_lineage(rows.withColumn("_start", free.cast("int")).drop("_before"))

    reached = rows.where("_start = 1").select(*keys, "second")
    jump = cut_lineage(_successors(rows, keys, seconds))
    found = reached
    while True:
        step = cut_lineage(
            found.join(jump, [*keys, "second"]).select(*keys, F.col("next").alias("second"))
        )
        if step.isEmpty():
            break
        found = found.unionByName(step)
        after = jump.select(*keys, F.col("second").alias("next"), F.col("next").alias("_next"))
        jump = cut_lineage(
            jump.join(after, [*keys, "next"]).select(*keys, "second", F.col("_next").alias("next"))
        )
    return rows.join(found, [*keys, "second"]).select(*keys, "second", id_col)


def _successors(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """(keys, second, next): the first request at least ``seconds`` later, unless accepted anyway.

    Looks up the next time by a running minimum over requests and their due
    times, walked backwards; a request sorts before the due times it serves.
    """
    points = rows.select(
        *keys, "second", (-F.col("second")).alias("_back"), F.lit(0).alias("_due"),
        (F.col("second") * 2 + F.col("_start")).alias("_at"),
    ).unionByName(
        rows.select(
            *keys, "second", (-F.col("second") - seconds).alias("_back"), F.lit(1).alias("_due"),
            F.lit(None).cast("bigint").alias("_at"),
        )
    )
    looked_up = running(
        points, keys, ["_back", "_due"], F.col("_at"), "_next",
        F.floor(F.col("_back") / DAY_SECONDS), how="min", null_keys=False,
    )
    return looked_up.where("_due = 1 and _next is not null and _next % 2 = 0").select(
        *keys, "second", F.call_function("div", F.col("_next"), F.lit(2)).alias("next")
    )
