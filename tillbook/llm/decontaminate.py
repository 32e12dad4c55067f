"""Benchmark decontamination: a hash set of normalised test n-grams against all training windows.

Main path in DataFrame functions only. The set of benchmark windows is bounded
and checked; its 64-bit hashes go to every task with the plan, so a document is
scanned where it is read. Windows that pass are few; they are compared as text
with the benchmark's windows. A benchmark too large for that is met by a
shuffled join of all windows instead, with the same result.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import cut_lineage

WINDOW = 10
# Most distinct benchmark windows whose hashes are sent to every task (8 bytes each).
SET_WINDOWS = 200_000
# Fixed value: bytes below 0x80 that are neither digits nor lower-case letters separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """Words of a text, A to Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int, *, item: str, text: str) -> DataFrame:
    """(gram, size, items): each distinct window, its words joined by spaces, with the items it occurs in."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("size", F.least(F.lit(window), F.size("words")))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("size") + 1),
        lambda i: F.array_join(F.slice("words", i, F.col("size")), " "),
    )
    return (
        rows.select("item", "size", F.explode(F.array_distinct(grams)).alias("gram"))
        .groupBy("gram", "size").agg(F.collect_set("item").alias("items"))
    )


def _probe(start: str, size: int) -> str:
    """Hash of three words of the window at ``start``; cheap, and enough to pass over most."""
    at = sorted({0, size // 2, size - 1})
    return "xxhash64(" + ", ".join(f"words[{start} + {k}]" for k in at) + ")"


def _candidates(windows: DataFrame) -> str:
    """SQL expression over ``words``: windows (start from 0, size, gram) that may be in the benchmark."""
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]
    small = windows.limit(SET_WINDOWS + 1).count() <= SET_WINDOWS
    parts = []
    for size in sizes:
        keep = "true"
        if small:
            split = F.split("gram", " ")
            own = windows.where(F.col("size") == size).select(F.xxhash64(split).alias("whole"), split.alias("words"))
            own = own.withColumn("probe", F.expr(_probe("0", size)))
            found = own.select("whole", "probe").collect()
            listed = lambda name: ", ".join(f"{v}L" if v > -(1 << 63) else "cast(-9223372036854775808 AS bigint)" for v in sorted({r[name] for r in found}))
            keep = f"{_probe('i - 1', size)} IN ({listed('probe')}) AND xxhash64(slice(words, i, {size})) IN ({listed('whole')})"
        starts = f"filter(sequence(1, size(words) - {size - 1}), i -> {keep})"
        parts.append(
            f"if(size(words) < {size}, array(), transform({starts}, i -> named_struct("
            f"'start', i - 1, 'size', {size}, 'gram', array_join(slice(words, i, {size}), ' '))))"
        )
    empty = "cast(array() AS array<struct<start:int,size:int,gram:string>>)"
    return f"concat({', '.join([empty, *parts])})"


def find(
    docs: DataFrame, benchmark: DataFrame, *, keep: list, window: int = WINDOW,
    text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, with n_words, spans and items.

    spans: array of (start, size) in words from 0, every occurrence of a benchmark
    window, in order; items: the benchmark items with occurring windows. An item
    of fewer than ``window`` words is one window; items and texts that are null
    or without words have none. Repeated items and rows count each as they stand.
    Columns not kept play no part; ``keep`` may hold expressions.
    """
    windows = cut_lineage(benchmark_windows(benchmark, window, item=item, text=item_text))
    rows = docs.select(*keep, words_of(F.col(text)).alias("words"))
    names = rows.columns[:-1]
    rows = rows.select(*names, F.size("words").alias("n_words"), F.expr(_candidates(windows)).alias("found"))
    # without the texts; and row numbers hold from here on
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    hits = (
        rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*")
        .join(windows.select("gram", "size", "items"), ["gram", "size"])
        .groupBy("_row").agg(
            F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
    )
    none = F.array()
    return rows.drop("found").join(hits, "_row", "left").select(
        *names, "n_words",
        F.coalesce("spans", none.cast("array<struct<start:int,size:int>>")).alias("spans"),
        F.coalesce("items", none.cast("array<string>")).alias("items"),
    )


def covered(spans):
    """How many words sorted spans cover together."""
    state = lambda n, upto: F.struct(n.cast("int").alias("n"), upto.cast("int").alias("upto"))

    def step(a, s):
        end = s["start"] + s["size"]
        return state(a["n"] + F.greatest(F.lit(0), end - F.greatest(a["upto"], s["start"])), F.greatest(a["upto"], end))

    return F.aggregate(spans, state(F.lit(0), F.lit(0)), step, lambda a: a["n"])


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all their columns unchanged.

    Texts decide: equal texts go or stay together. Null texts stay.
    """
    key = F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    found = find(docs, benchmark, keep=[key.alias("_key")], text=text, **options)
    bad = found.where(F.size("spans") > 0).select("_key").distinct()
    return docs.join(bad, key == bad["_key"], "left_anti")
