"""Writing tables: append, reload, bucketed copies, versioned upserts, exports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.sources.schema import EXPORTABLE_TABLES
from tillbook.sources.shop import Shop

# Parent key of each fact, so that headers and lines can be bucketed alike.
BUCKET_KEYS = {
    "orders": "id", "order_items": "order_id",
    "sales": "id", "sale_items": "sale_id", "sale_payments": "sale_id",
}


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def reload(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces the table, or with ``partition_by`` only the partitions the rows belong to."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def save_by_month(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Facts by month and sorted by time within files: date filters skip folders and row groups.

    Rows are split by sampled time ranges, so a busy day is written by several tasks.
    """
    month = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    (
        month.repartitionByRange("month", ts).sortWithinPartitions("month", ts)
        .write.mode("overwrite").partitionBy("month").parquet(path)
    )


def dated_lines(lines: DataFrame, headers: DataFrame, parent: str) -> DataFrame:
    """Lines with their header's ``created_at``, to be saved by month: a report on a few days then reads few of them."""
    return lines.join(headers.select(F.col("id").alias(parent), "created_at"), parent)


def save_bucketed(shop: Shop, database: str, buckets: int, tables: Iterable[str] = tuple(BUCKET_KEYS)) -> None:
    """Managed copies of the facts, bucketed and sorted by the header's id.

    Joins of lines with headers on that id then need no shuffle.
    """
    for name in tables:
        key = BUCKET_KEYS[name]
        df = getattr(shop, name)
        (
            df.repartition(buckets, key).write.mode("overwrite").format("parquet")
            .bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")
        )


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str], mode: str = "append") -> None:
    df.write.jdbc(url, table, mode=mode, properties=dict(properties))


def export_name(table: str, stamp: str, structure: bool = False) -> str:
    return f"structure_{table}_{stamp}" if structure else f"data_{table}_{stamp}"


def export_tables(
    shop: Shop, folder: str, stamp: str, tables: Iterable[str] | None = None, structure_only: bool = False
) -> list[str]:
    """Writes allowed tables (all the shop has, or those named) under time-stamped names.

    Structure is the schema as JSON. Asking for any other table is an error.
    """
    present = set(shop.names())
    wanted = list(tables) if tables is not None else [t for t in EXPORTABLE_TABLES if t in present]
    unknown = [t for t in wanted if t not in EXPORTABLE_TABLES]
    if unknown:
        raise ValueError(f"unknown table: {unknown[0]}")
    paths = []
    for table in wanted:
        path = f"{folder}/{export_name(table, stamp, structure_only)}"
        df = getattr(shop, table)
        if structure_only:
            shop.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(path)
        else:
            df.write.parquet(path)
        paths.append(path)
    return paths


def literal_rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table, part of the plan itself.

    Values may be text, whole numbers, booleans or null.
    """
    def literal(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v).lower()

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
