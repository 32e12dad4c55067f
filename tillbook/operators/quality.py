"""Data checks: domains, uniqueness, references, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.text import is_filled, key_of


def domain_check(df: DataFrame, rules: dict[str, Column], out: str = "failed") -> DataFrame:
    """Adds the sorted names of the rules a row breaks; an unknown outcome counts as broken."""
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())
    ]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def split_checked(checked: DataFrame, out: str = "failed") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reasons."""
    good = F.size(out) == 0
    return checked.where(good).drop(out), checked.where(~good)


def within(col: Column, low, high) -> Column:
    return col.between(low, high)


def whole_at_least(col: Column, low: int) -> Column:
    return (col == F.floor(col)) & (col >= low)


def duplicate_keys(df: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """Keys used by several rows, with the number of rows and the lowest id."""
    return (
        df.where(key.isNotNull()).groupBy(key.alias("key"))
        .agg(F.count(F.lit(1)).alias("uses"), F.min(id_col).alias("first_id"))
        .where("uses > 1")
    )


def key_conflicts(
    candidates: DataFrame,
    existing: list[tuple[DataFrame, str]],
    column: str,
    id_col: str = "id",
    own_id: bool = True,
    normalise=key_of,
) -> DataFrame:
    """Adds ``available`` to each candidate: its key is used by nobody else.

    ``existing`` lists the tables a key must be free in, with their column. The
    first is the candidate's own table, whose row with the candidate's id does
    not count (``own_id``). Every table is reduced to one row per key holding
    its lowest and highest id, which is enough to tell whether another row uses
    the key, so no pairs of equal keys are ever formed. Blank keys are free.
    """
    out = candidates.withColumn("_key", normalise(F.col(column)))
    taken = F.lit(False)
    for n, (table, used_column) in enumerate(existing):
        key, low, high = f"_key{n}", f"_low{n}", f"_high{n}"
        used = (
            table.where(is_filled(F.col(used_column)))
            .groupBy(normalise(F.col(used_column)).alias(key))
            .agg(F.min(id_col).alias(low), F.max(id_col).alias(high))
        )
        out = out.join(used, out["_key"] == used[key], "left").drop(key)
        if n == 0 and own_id:
            mine = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
            other = (F.col(low).cast("string") != mine) | (F.col(high).cast("string") != mine)
            taken = taken | F.coalesce(other, F.lit(False))
        else:
            taken = taken | F.col(low).isNotNull()
    helpers = ["_key", *[f"_{p}{n}" for n in range(len(existing)) for p in ("low", "high")]]
    return out.withColumn("available", ~taken | ~is_filled(F.col(column))).drop(*helpers)


def orphans(children: DataFrame, fk: str, parents: DataFrame, pk: str = "id") -> DataFrame:
    """Children whose parent does not exist; a null reference is no orphan."""
    keys = parents.select(F.col(pk).alias(fk))
    return children.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def set_null(children: DataFrame, fk: str, parents: DataFrame, pk: str = "id") -> DataFrame:
    """Parents removed: their children keep the row and lose the reference."""
    keys = parents.select(F.col(pk).alias("_pk"))
    joined = children.join(keys, children[fk] == F.col("_pk"), "left")
    return joined.withColumn(fk, F.col("_pk")).drop("_pk").select(*children.columns)


def cascade(children: DataFrame, fk: str, parents: DataFrame, pk: str = "id") -> DataFrame:
    """Parents removed: their children go too."""
    return children.join(parents.select(F.col(pk).alias(fk)), fk, "left_semi").select(*children.columns)


def completeness(df: DataFrame, sections: dict[str, list[str]], id_col: str) -> DataFrame:
    """Per row: which sections have all columns filled, how many, and the rounded percent."""
    flags = {}
    for name, cols in sections.items():
        flag = F.lit(True)
        for c in cols:
            flag = flag & is_filled(F.col(c))
        flags[name] = flag
    n = len(sections)
    done = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return df.select(
        id_col,
        *[f.alias(f"{name}_complete") for name, f in flags.items()],
        done.alias("completed_count"),
        F.lit(n).alias("total_count"),
        # half-up percent in whole numbers: (200 d + n) / 2n
        F.call_function("div", done * 200 + n, F.lit(2 * n)).cast("int").alias("percent"),
    )


def column_fill(df: DataFrame) -> DataFrame:
    """Filled values per column of a table: (column_name, filled, total), in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count(F.when(is_filled(F.col(c)), 1)).alias(c) for c in df.columns],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in df.columns]
    )
    return counts.select("_total", F.inline(pairs)).select(
        "column_name", "filled", F.col("_total").alias("total")
    )


def permutation_check(lists: DataFrame, group: str, key: str, position: str, keys: list[str]) -> DataFrame:
    """Per group: the list names every fixed key exactly once, with integer positions.

    Counts instead of collecting the list, so a wrong list of any length is cheap.
    """
    per_key = lists.groupBy(group, key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col(position).isNull() | (F.col(position) != F.floor(position)), 1)).alias("_bad"),
    )
    known = F.col(key).isin(keys)
    return (
        per_key.groupBy(group)
        .agg(
            F.count(F.when(known & (F.col("_n") == 1), 1)).alias("_right"),
            F.count(F.when(~F.coalesce(known, F.lit(False)) | (F.col("_n") > 1), 1)).alias("_wrong"),
            F.sum("_bad").alias("_bad"),
        )
        .select(
            group,
            ((F.col("_right") == len(keys)) & (F.col("_wrong") == 0) & (F.col("_bad") == 0)).alias("valid"),
        )
    )


def all_rows_satisfy(df: DataFrame, group: str, rule: Column, out: str) -> DataFrame:
    return df.groupBy(group).agg(F.bool_and(rule).alias(out))
