"""Substring search by an index of trigrams, with exact verification.

Three tables in one folder, each written as a version: ``postings`` (gram, id,
part) by the hash of the gram, ``rows`` (the searched texts) by the hash of the
id, and ``counts`` of rows per gram. A search looks up how frequent the needle's
grams are, reads the postings of the rarest, then only the parts of ``rows`` that
hold ids with all of them, and checks their texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions.text import contains_pattern, fold
from tillbook.operators.ranking import latest_per_key
from tillbook.session import cut_lineage

GRAM = 3
# Grams of a needle that are looked up; the texts of what has them are checked in full.
RAREST = 4
BUCKETS = 64


def _grams(text: Column) -> Column:
    """Different trigrams of a folded text; none for null and shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    some = F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def _hashed(x: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")


def write_index(
    df: DataFrame, id: str, columns: list[str], path: str, version: int = 0, buckets: int = BUCKETS
) -> None:
    """Adds ``df`` to the index as a version; the same version is replaced, other versions' files stay.

    Of an id in several versions the highest counts, so new and changed rows are
    added by a version of their own; deleted ones drop out where the result meets
    the table. ``buckets`` must be the same in all versions. Rows without an id
    are left out. Postings are split by sampled ranges, so a frequent gram is
    written by several tasks.
    """
    texts = F.array(*[F.col(c).cast("string") for c in columns]).alias("texts")
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), texts, _hashed(F.col(id), buckets).alias("part"))
    rows.repartitionByRange("part", "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/version={version}")
    # a text is folded once, not for each of its grams
    every = F.array_distinct(F.flatten(F.transform(F.transform("texts", fold), _grams)))
    # spread first, by number: a table in one small file is one task, but its grams are many times its size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = rows.repartition(tasks, "id").select("id", "part", F.explode(every).alias("gram")).withColumn("bucket", _hashed(F.col("gram"), buckets))
    (
        grams.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/version={version}")
    )
    id_type = df.schema[id].dataType.simpleString()
    written = _read(df.sparkSession, path, "postings", id_type).where(F.col("version") == version)
    counted = written.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counted.repartitionByRange("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts/version={version}")


def _read(spark: SparkSession, path: str, table: str, id_type: str) -> DataFrame:
    schema = {"postings": f"gram string, id {id_type}, part int, bucket int", "counts": "gram string, n bigint, bucket int",
              "rows": f"id {id_type}, texts array<string>, part int"}
    known = spark.read.schema(f"{schema[table]}, version int").option("basePath", f"{path}/{table}")
    return known.parquet(f"{path}/{table}/version=*")


def needle_grams(spark: SparkSession, needle: str) -> list[str]:
    """Trigrams that a text must have to match; none where the parts between wildcards are shorter."""
    folded = spark.sql("SELECT 1").select(fold(F.lit(needle))).first()[0]
    parts = re.split(r"[%_\\]", folded)
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def matching_ids(
    spark: SparkSession, path: str, needle: str, id_type: str = "bigint", buckets: int = BUCKETS
) -> DataFrame:
    """id of every indexed row of which any column holds ``needle``, as ``contains_pattern`` has it.

    A needle without a trigram reads all texts. What comes to the driver is
    bounded by the needle and by ``buckets``.
    """
    rows, grams = _read(spark, path, "rows", id_type), needle_grams(spark, needle)
    if grams:
        # known now, so that the folders are chosen when the plan is made
        places = spark.sql("SELECT 1").select(*[_hashed(F.lit(g), buckets) for g in grams]).first()
        of_gram = dict(zip(grams, places))
        known = _of(_read(spark, path, "counts", id_type), grams, of_gram).groupBy("gram").agg(F.sum("n").alias("n"))
        times = {r["gram"]: r["n"] for r in known.collect()}
        wanted = sorted(grams, key=lambda g: (times.get(g, 0), g))[:RAREST]
        bit = F.lit(0)
        for i, g in enumerate(wanted):
            bit = F.when(F.col("gram") == g, 1 << i).otherwise(bit)
        postings = _of(_read(spark, path, "postings", id_type), wanted, of_gram).select("part", "id", bit.alias("bit"))
        # partial aggregates leave one row per id and task before the shuffle
        having = postings.groupBy("part", "id").agg(F.bit_or("bit").alias("bits"))
        found = cut_lineage(having.where(F.col("bits") == (1 << len(wanted)) - 1).select("part", "id"))
        parts = [r["part"] for r in found.select("part").distinct().collect()]
        rows = rows.where(F.col("part").isin(parts)).join(found, ["part", "id"], "left_semi")
    newest = latest_per_key(rows, ["id"], ["version"])
    return newest.where(F.exists("texts", lambda t: contains_pattern(needle, t))).select("id")


def _of(table: DataFrame, grams: list[str], bucket: dict[str, int]) -> DataFrame:
    """The rows of some grams, from their buckets' folders."""
    return table.where(F.col("bucket").isin(sorted({bucket[g] for g in grams})) & F.col("gram").isin(grams))
