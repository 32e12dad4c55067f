from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, table
from tillbook.plans import rankings, rollups
from tillbook.sources import testbed


@pytest.fixture(scope="module")
def shop(spark):
    """Both channels with lines that carry their header's date."""
    made = testbed.trade(spark, SF)
    dated = {}
    for headers, lines, parent in (("orders", "order_items", "order_id"), ("sales", "sale_items", "sale_id")):
        heads = getattr(made, headers).select(F.col("id").alias(parent), "created_at")
        dated[lines] = getattr(made, lines).join(heads, parent)
    return made.replace(**dated)


def files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


@pytest.mark.parametrize("as_of, days", [("2001-08-01 00:00:00", 7), ("2001-07-15 13:45:10", 3), ("2002-01-01 00:00:00", 7), (None, 7)])
@pytest.mark.parametrize("net", [False, True])
def test_units_from_days_are_those_of_the_lines(shop, tmp_path, as_of, days, net):
    rollups.refresh_units(shop, str(tmp_path), net=net)
    got = rollups.units_since(shop, str(tmp_path), as_of, days, net)
    want = rankings.product_units(shop, as_of, days if as_of else None, net)
    assert table(got) == table(want)


def test_changed_days_only_are_written(spark, shop, tmp_path):
    rollups.refresh_units(shop, str(tmp_path))
    before = files(tmp_path)
    sold = rankings.combined_items(shop).groupBy(F.to_date("created_at").alias("day")).count().orderBy("day").collect()
    gone, less = sold[3]["day"], sold[-2]["day"]
    # an order of one day is corrected, another day's are all called off
    day = F.to_date("created_at")
    orders = shop.orders.withColumn("status", F.when(day == F.lit(gone), "cancelled").otherwise(F.col("status")))
    lines = shop.order_items.withColumn("quantity", F.when(day == F.lit(less), F.col("quantity") + 1).otherwise(F.col("quantity")))
    sales = shop.sales.where(day != F.lit(gone))
    now = shop.replace(orders=orders, order_items=lines, sales=sales)
    rollups.refresh_units(now, str(tmp_path), [str(gone), less])
    after = files(tmp_path)
    touched = {name.split("/")[0] for name, when in {**before, **after}.items() if before.get(name) != after.get(name)}
    assert touched == {f"day={gone}", f"day={less}"}
    assert table(rollups.units_since(now, str(tmp_path))) == table(rankings.product_units(now))
    rollups.refresh_units(now, str(tmp_path), [])
    assert files(tmp_path) == after


def test_a_week_reads_its_days(spark, shop, tmp_path):
    rollups.refresh_units(shop, str(tmp_path))
    last = rankings.combined_items(shop).agg(F.max(F.to_date("created_at"))).first()[0]
    earlier = [f for f in tmp_path.glob("day=*") if f.name < f"day={last - timedelta(days=7)}"]
    assert len(earlier) > 500
    for folder in earlier:  # can't be read any more
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"not a table")
    as_of = f"{last} 00:00:00"
    got = rollups.units_since(shop, str(tmp_path), as_of)
    assert table(got) == table(rankings.product_units(shop, as_of, 7))
    assert 0 < len({f.split("/")[-2] for f in got.inputFiles() if "/day=" in f}) <= 8


def test_rankings_take_the_units(shop, tmp_path):
    rollups.refresh_units(shop, str(tmp_path))
    as_of = testbed.TRADE_AS_OF
    units = rollups.units_since(shop, str(tmp_path), as_of)
    assert table(rankings.hot_categories(shop, as_of, units=units)) == table(rankings.hot_categories(shop, as_of))
