"""Where the shop's tables come from: a lazy, named set of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tillbook.sources.schema import TABLES


class Shop:
    """Named tables, each built when first asked for: ``shop.orders``, ``shop.products`` …"""

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._loaders[name]()
        return self._built[name]

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def replace(self, **tables: DataFrame) -> "Shop":
        """The same shop with some tables swapped."""
        loaders = dict(self._loaders)
        loaders.update({k: (lambda df=df: df) for k, df in tables.items()})
        return Shop(self.spark, loaders)


def from_frames(spark: SparkSession, **tables: DataFrame) -> Shop:
    return Shop(spark, {k: (lambda df=df: df) for k, df in tables.items()})


def from_files(spark: SparkSession, root: str, fmt: str = "parquet", **options: str) -> Shop:
    """One folder per table under ``root``; the schema is given, never inferred."""

    def load(name: str) -> DataFrame:
        reader = spark.read.schema(TABLES[name]).format(fmt).options(**options)
        return reader.load(f"{root}/{name}")

    return Shop(spark, {name: (lambda n=name: load(n)) for name in TABLES})


def from_jdbc(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str] | None = None,
    partitions: int = 10,
    bounds: Mapping[str, tuple[int, int]] | None = None,
) -> Shop:
    """Tables of a relational database.

    Tables with an entry in ``bounds`` (lowest and highest id) are read in
    ``partitions`` parallel id ranges, the others over one connection.
    """
    bounds = bounds or {}

    def load(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in (properties or {}).items():
            reader = reader.option(key, value)
        if name in bounds:
            low, high = bounds[name]
            reader = (
                reader.option("partitionColumn", "id")
                .option("lowerBound", low)
                .option("upperBound", high)
                .option("numPartitions", partitions)
            )
        return reader.load()

    return Shop(spark, {name: (lambda n=name: load(n)) for name in TABLES})


def from_catalog(spark: SparkSession, database: str) -> Shop:
    """Managed tables, for example the bucketed copies written by ``sinks.save_bucketed``."""
    return Shop(spark, {n: (lambda n=n: spark.table(f"{database}.{n}")) for n in TABLES})
