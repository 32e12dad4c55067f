from __future__ import annotations

import re
import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillbook.session import local_session  # noqa: E402
from tillbook.sources.schema import TABLES  # noqa: E402
from tillbook.sources.shop import from_frames  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(4, "4g", **{"spark.sql.warehouse.dir": str(warehouse)})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make("orders", "id status total_amount", (1, "pending", 5)) with the table's own types."""

    def convert(value, kind: str):
        if value is None:
            return None
        if kind.startswith("decimal"):
            return Decimal(str(value))
        if kind == "timestamp_ntz" and isinstance(value, str):
            return datetime.fromisoformat(value)
        if kind == "date" and isinstance(value, str):
            return date.fromisoformat(value)
        return value

    def build(table: str, columns: str, *rows):
        types = {}
        for field in re.split(r",\s*(?![0-9])", TABLES.get(table, table)):
            name, kind = field.strip().split(" ", 1)
            types[name] = kind.strip()
        names = columns.split() if columns else list(types)
        data = [tuple(convert(v, types[n]) for n, v in zip(names, r)) for r in rows]
        return spark.createDataFrame(data, ", ".join(f"{n} {types[n]}" for n in names))

    return build


@pytest.fixture(scope="session")
def shop_of(spark):
    return lambda **tables: from_frames(spark, **tables)


def table(df, *cols):
    """Rows as plain tuples, decimals as floats, sorted."""
    def plain(v):
        return float(v) if isinstance(v, Decimal) else v

    rows = [tuple(plain(v) for v in r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
