"""Units per product and day, kept as a table that changes by the day."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.common import instant
from tillbook.plans.rankings import combined_items
from tillbook.sources import sinks
from tillbook.sources.shop import Shop

_SCHEMA = "product_id bigint, units bigint, day date"


def refresh_units(shop: Shop, path: str, days: Iterable[str | date] | None = None, net: bool = False) -> None:
    """Writes the units of these days, or of all days, anew; other days' files stay as they are.

    ``days`` are those on which an order or sale changed, late ones included.
    Only their headers (and, where lines carry the date, their lines) are read.
    A day is written even if nothing is left of it, so what was there goes.
    """
    if days is None:
        _per_day(combined_items(shop, net=net)).write.mode("overwrite").partitionBy("day").parquet(path)
        return
    wanted = sorted({str(d)[:10] for d in days})
    if not wanted:
        return
    first, last = date.fromisoformat(wanted[0]), date.fromisoformat(wanted[-1])
    changed = (
        (F.col("created_at") >= instant(f"{first} 00:00:00")) & (F.col("created_at") < instant(f"{last + timedelta(days=1)} 00:00:00"))
        & F.to_date("created_at").isin([date.fromisoformat(d) for d in wanted])
    )
    rows = _per_day(combined_items(shop, net=net, when=changed))
    marks = sinks.literal_rows(shop.spark, ["d"], [(d,) for d in wanted]).select(
        F.lit(None).cast("bigint").alias("product_id"), F.lit(0).cast("bigint").alias("units"), F.col("d").cast("date").alias("day")
    )
    sinks.reload(rows.unionByName(marks), path, partition_by="day")


def _per_day(items: DataFrame) -> DataFrame:
    """A row per product and day; sampled ranges, so a day is few files and a busy one is split."""
    units = items.groupBy("product_id", F.to_date("created_at").alias("day")).agg(F.sum("quantity").cast("bigint").alias("units"))
    return units.repartitionByRange("day", "product_id").select("product_id", "units", "day")


def _since(shop: Shop, path: str, day: date) -> DataFrame:
    """The table's rows from a day on; only the names of older folders are listed."""
    text = str(day)
    later = [f"{text[:i]}[{int(c) + 1}-9]*" for i, c in enumerate(text) if c.isdigit() and c != "9"]
    folders = f"{path}/day={{{','.join([text, *later])}}}"
    try:
        return shop.spark.read.schema(_SCHEMA).option("basePath", path).parquet(folders)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return shop.spark.createDataFrame([], _SCHEMA)


def units_since(shop: Shop, path: str, as_of: str | None = None, days: int = 7, net: bool = False) -> DataFrame:
    """Units per product of the last ``days``, as ``rankings.product_units``, from the table.

    Whole days come from their folders. Where the range begins within a day, that
    day's part is summed from the lines. Without ``as_of`` all days count.
    """
    if as_of is None:
        return _summed(shop.spark.read.schema(_SCHEMA).parquet(path))
    start = datetime.fromisoformat(as_of) - timedelta(days=days)
    midnight = datetime.combine(start.date(), datetime.min.time())
    whole = midnight if start == midnight else midnight + timedelta(days=1)
    units = _since(shop, path, whole.date()).select("product_id", "units")
    if start != whole:
        begun = (F.col("created_at") >= instant(start)) & (F.col("created_at") < instant(whole))
        part = combined_items(shop, net=net, when=begun).select("product_id", F.col("quantity").cast("bigint").alias("units"))
        units = units.unionByName(part)
    return _summed(units)


def _summed(units: DataFrame) -> DataFrame:
    return units.where("product_id is not null").groupBy("product_id").agg(F.sum("units").cast("bigint").alias("total_sold"))
