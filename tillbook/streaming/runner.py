"""Running a stream over what is there and reading its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.ranking import latest_per_key
from tillbook.session import shared_dir


# Buckets of a merged table; a micro-batch writes those that it touches.
BUCKETS = 64
_LIST = "bucket int, version long, filled boolean"


def start_versions(stream: DataFrame, out: str, checkpoint: str, mode: str = "update"):
    """Writes each micro-batch as its own version, once: a retried batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def run_available(stream: DataFrame, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Processes all input there is and returns every written row with its ``version``."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = start_versions(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("version", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out")


def run_merged(
    stream: DataFrame, bucket_by: list[str], combine: Callable[[DataFrame], DataFrame], folder: str | None = None,
    buckets: int = BUCKETS, mode: str = "update", leave: Column | None = None,
) -> DataFrame:
    """Merges every micro-batch into a table, bucket by bucket, and returns the table.

    Rows lie in ``buckets`` buckets by the hash of ``bucket_by``. ``combine``
    gets the rows of the touched buckets, old ones with ``_batch`` false and the
    batch's with true, and gives the rows that stay; it must not mix rows that
    differ in ``bucket_by``. Only touched buckets are written, each as a version
    named by the batch; a small list says which buckets a
    batch wrote. A batch that is run again starts from the versions before it and
    replaces its own, so nothing counts twice. Older versions stay in the folder.
    Rows for which ``leave`` is true go to the folder ``left``, once, and are not
    merged again; it may use windows within ``_bucket``. See ``run_closing``.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("_bucket", T.IntegerType())])
    if _versions(spark, folder) is None:
        spark.createDataFrame([], _LIST).write.mode("overwrite").parquet(f"{folder}/list/batch=-1")
        if leave is not None:
            spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/left/version=-1")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/out/version={batch_id}")

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*bucket_by), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r["_bucket"] for r in dealt.select("_bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            known = _versions(own, folder, before=batch_id)
            rows = dealt.withColumn("_batch", F.lit(True))
            old = [_path(folder, known[b], b) for b in touched if b in known]
            if old:
                held = own.read.schema(schema).option("basePath", f"{folder}/out").parquet(*old).select(schema.names)
                rows = rows.unionByName(held.withColumn("_batch", F.lit(False)))
            merged = combine(rows).select(*schema.names)
            filled = set(touched)
            if leave is None:
                write(merged, batch_id)
            else:
                merged = merged.withColumn("_leaves", F.coalesce(leave, F.lit(False))).persist()
                try:
                    gone = merged.where("_leaves").select(*stream.columns)
                    gone.write.mode("overwrite").parquet(f"{folder}/left/version={batch_id}")
                    stay = merged.where("not _leaves").select(*schema.names)
                    write(stay, batch_id)
                    filled = {r["_bucket"] for r in stay.select("_bucket").distinct().collect()}
                finally:
                    merged.unpersist()
            own.createDataFrame([(b, batch_id, b in filled) for b in touched], _LIST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/list/batch={batch_id}")
        finally:
            dealt.unpersist()

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(merge).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    now = _versions(spark, folder)
    if not now:
        return spark.createDataFrame([], stream.schema)
    paths = [_path(folder, version, b) for b, version in sorted(now.items())]
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(*paths).select(*stream.columns)


def _path(folder: str, version: int, bucket: int) -> str:
    return f"{folder}/out/version={version}/_bucket={bucket}"


def _versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int] | None:
    """The newest version of every bucket that has rows, of those before a batch; None if the table was never begun."""
    try:
        made = spark.read.schema(_LIST).parquet(f"{folder}/list")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if before is not None:
        made = made.where(F.col("version") < before)
    latest = made.groupBy("bucket").agg(F.max(F.struct("version", "filled")).alias("now")).where("now.filled")
    return {r["bucket"]: r["version"] for r in latest.select("bucket", "now.version").collect()}


def run_closing(
    stream: DataFrame, bucket_by: list[str], combine: Callable[[DataFrame], DataFrame], leave: Column,
    folder: str | None = None, buckets: int = BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """A merged table that rows leave when they are over: (the rows still in it, the rows that left, each once).

    So the table is as large as what is open, however long the stream runs. A
    late row of something that has left is merged by itself and leaves as a
    correction, so combining what left gives whole results.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    kept = run_merged(stream, bucket_by, combine, folder, buckets, mode="append", leave=leave)
    return kept, spark.read.schema(stream.schema).parquet(f"{folder}/left/*")


def run_upsert(stream: DataFrame, keys: list[str], order: list[str], folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Keeps the latest row of each key in a table that every micro-batch is merged into; see ``run_merged``."""
    return run_merged(stream, keys, lambda rows: latest_per_key(rows.drop("_batch"), keys, order), folder, buckets, mode="append")


def run_top(stream: DataFrame, window: list[str], key: list[str], score: str, k: int, folder: str | None = None) -> DataFrame:
    """The k rows with the highest score of each window, ranked, kept while the stream runs.

    ``stream`` gives the new score of every key that changed, in update mode.
    Scores must not fall: then a key that is not among the k can only come in
    with a change of its own, and k rows per window are all that is kept.
    """
    by_score = Window.partitionBy(*window).orderBy(F.col(score).desc(), *key)

    def best(rows: DataFrame) -> DataFrame:
        newest_of_key = latest_per_key(rows, [*window, *key], ["_batch", score])
        return newest_of_key.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= k)

    kept = run_merged(stream, window, best, folder)
    return kept.withColumn("rank", F.row_number().over(by_score))


def newest(rows: DataFrame) -> DataFrame:
    """The last version as a whole: what a complete-mode result table holds now."""
    return rows.join(rows.agg(F.max("version").alias("version")), "version").drop("version")


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest version of each key: what an update-mode result table holds now."""
    return latest_per_key(rows, keys, ["version"]).drop("version")
