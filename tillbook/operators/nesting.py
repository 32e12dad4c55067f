"""Child rows as an array on their parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    parent_key: str,
    child_key: str,
    fields: list[str],
    sort_field: str,
    out: str = "items",
) -> DataFrame:
    """Left-joins the children of each parent as one whole array of structs, sorted by ``sort_field``.

    Parents without children get an empty array. The children move once, by
    their parent. An array is one value of one row; where a parent may have more
    children than a row can hold, use ``with_parent``, which keeps them as rows.
    """
    entry = F.struct(sort_field, *[f for f in fields if f != sort_field])
    nested = children.groupBy(F.col(child_key).alias("_parent")).agg(F.sort_array(F.collect_list(entry)).alias(out))
    joined = parents.join(nested, parents[parent_key] == F.col("_parent"), "left").drop("_parent")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(nested.schema[out].dataType)))


def with_parent(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, columns: list[str]) -> DataFrame:
    """The children as rows, each with ``columns`` of its parent."""
    own = parents.select(F.col(parent_key).alias("_parent"), *columns)
    return children.join(own, children[child_key] == F.col("_parent")).drop("_parent")


def items_text(items: Column, *fields: str) -> Column:
    """An array of structs as text, one ``a:b:c`` per entry, joined by ``|``."""
    def one(e):
        return F.concat_ws(":", *[e[f].cast("string") for f in fields])

    return F.concat_ws("|", F.transform(items, one))
