"""Set-based changes: (current rows, requested changes) -> new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators.ranking import earliest_per_key, latest_per_key


def upsert_latest(
    current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], resets: dict[str, Column] | None = None
) -> DataFrame:
    """One row per key: the latest incoming one, else the current one.

    Columns in ``resets`` take their given value on incoming rows.
    """
    for name, value in (resets or {}).items():
        incoming = incoming.withColumn(name, value)
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new", *order]).drop("_new")


def insert_missing(current: DataFrame, candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Candidates whose key is absent, the first of equal candidates only."""
    fresh = candidates.join(current.select(*keys), keys, "left_anti")
    return earliest_per_key(fresh, keys, order)


def insert_if_empty(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows, or nothing when the target already has any. Decided inside the plan."""
    return rows.where(~target.limit(1).exists())


def fill_missing(df: DataFrame, source: DataFrame, on: str, source_key: str, cols: list[str]) -> DataFrame:
    """Null values of ``cols`` taken from the matching source row."""
    src = source.select(F.col(source_key).alias("_k"), *[F.col(c).alias(f"_src_{c}") for c in cols])
    joined = df.join(src, df[on] == F.col("_k"), "left").drop("_k")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(c, f"_src_{c}"))
    return joined.select(*df.columns)


def partial_update(df: DataFrame, patches: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Applies one patch per key to the provided columns only.

    A patch carries ``has_<col>`` beside each value: provided null clears the
    column, not provided leaves it.
    """
    patch = patches.select(
        F.col(key).alias("_k"),
        *[F.col(f"has_{c}") for c in cols],
        *[F.col(c).alias(f"_to_{c}") for c in cols],
    )
    joined = df.join(patch, df[key] == F.col("_k"), "left")
    for c in cols:
        joined = joined.withColumn(c, F.when(F.coalesce(f"has_{c}", F.lit(False)), F.col(f"_to_{c}")).otherwise(F.col(c)))
    return joined.select(*df.columns)


def set_where_listed(df: DataFrame, ids: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Sets columns on the rows whose key is listed; soft delete, restore, approve, reject."""
    listed = ids.select(F.col(key).alias("_k")).distinct()
    joined = df.join(listed, df[key] == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    for c, value in changes.items():
        joined = joined.withColumn(c, F.when(hit, value).otherwise(F.col(c)))
    return joined.select(*df.columns)


def set_active(df: DataFrame, ids: DataFrame, active: bool, key: str = "id") -> DataFrame:
    return set_where_listed(df, ids, key, {"is_active": F.lit(active)})


def decide(users: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Applies approve / reject: the status and with it the active flag. Last decision wins.

    ``decisions`` has the key, ``approve`` (boolean) and ``decided_at``.
    """
    last = latest_per_key(decisions.select(F.col(key).alias("_k"), "approve", "decided_at"), ["_k"], ["decided_at"])
    joined = users.join(last, users[key] == F.col("_k"), "left")
    hit = F.col("approve").isNotNull()
    word = F.when(F.col("approve"), F.lit("approved")).otherwise(F.lit("rejected"))
    return (
        joined.withColumn("status", F.when(hit, word).otherwise(F.col("status")))
        .withColumn("is_active", F.when(hit, F.col("approve")).otherwise(F.col("is_active")))
        .select(*users.columns)
    )


def toggled_on(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present after all toggles: an odd number of them."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("toggles")).where("toggles % 2 = 1")


def rename_values(col: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    """Old values to new ones; others stay, or take ``otherwise``."""
    out = None
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new)) if out is None else out.when(col == old, F.lit(new))
    return out.otherwise(col if otherwise is None else otherwise)


def conform(
    df: DataFrame,
    schema: dict[str, str],
    defaults: dict[str, object] | None = None,
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """The table in a wanted shape: renamed, missing columns added, extra ones dropped, types cast.

    A rename applies only when the new name is not there yet.
    """
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    defaults = defaults or {}
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(defaults.get(c))).cast(t).alias(c)
            for c, t in schema.items()
        ]
    )
