from __future__ import annotations

import random
import tracemalloc
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, table
from tillbook.sources import testbed
from tillbook.plans import daybook
from tillbook.streaming import codes, live, runner, shifts, sources


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The events in five files, oldest first, so that the stream sees several batches."""
    folder = tmp_path_factory.mktemp("events")
    raw = testbed.raw(spark, SF, "events")
    for i in range(5):
        part = raw.where(F.floor((F.dayofmonth("ts") - 1) / 6) == i)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_batches_add_up_to_the_batch_result(spark, many_files):
    stream = sources.event_stream(spark, many_files, files_per_trigger=2)
    rows = runner.run_available(live.x_report(live.event_sales(stream)))
    assert rows.select("version").distinct().count() >= 3
    batch = live.x_report(live.event_sales(testbed.events(spark, SF)))
    assert table(runner.current(rows, ["shift_id"])) == table(batch)


def test_stock_and_units_match_the_batch(spark, many_files):
    events = testbed.events(spark, SF)
    stream = sources.event_stream(spark, many_files, files_per_trigger=2)
    products = events.select("user_id").distinct().selectExpr("user_id as id", "cast(user_id % 7 as int) as stock")
    moved = runner.current(runner.run_available(live.stock(live.event_moves(stream), products)), ["product_id"])
    assert table(moved) == table(live.stock(live.event_moves(events), products))
    units = runner.run_available(live.trailing_units(live.event_items(stream), delay="40 days"))
    batch = live.trailing_units(live.event_items(events))
    assert table(runner.current(units, ["until", "product_id"])) == table(batch)


def test_repeats_are_dropped(spark, many_files):
    stream = sources.event_stream(spark, many_files, files_per_trigger=2)
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = runner.run_available(live.unique_events(doubled, ["event_id"], delay="40 days"), mode="append")
    assert out.count() == out.select("event_id").distinct().count() == testbed.events(spark, SF).count()


def parquet_files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_upsert_writes_only_what_it_touches(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "table"
    schema = "k long, t long, v string"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        return runner.run_upsert(spark.readStream.schema(schema).parquet(str(source)), ["k"], ["t"], str(folder), buckets=8)

    assert add(*[(i, 1, "a") for i in range(40)]).count() == 40
    before = parquet_files(folder / "out")
    out = add((3, 2, "b"), (3, 1, "late"), (99, 1, "new"))
    after = parquet_files(folder / "out")
    assert {r.k: r.v for r in out.collect()} == {**{i: "a" for i in range(40)}, 3: "b", 99: "new"}
    assert before.items() <= after.items()
    touched = {name.split("_bucket=")[1].split("/")[0] for name in after.keys() - before.keys()}
    assert 1 <= len(touched) <= 2
    # a batch that is run again starts from what was there before it
    again = runner._versions(spark, str(folder), before=1)
    assert set(again.values()) == {0} and len(again) == 8


def test_upsert_with_more_batches_than_progress_keeps(spark, many_files):
    stream = sources.event_stream(spark, many_files, files_per_trigger=1).select("user_id", "event_id", "ts")
    out = runner.run_upsert(stream, ["user_id"], ["ts", "event_id"], buckets=4)
    events = testbed.events(spark, SF)
    want = {}
    for r in sorted(events.select("user_id", "ts", "event_id").collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.user_id] = r.event_id
    assert {r.user_id: r.event_id for r in out.collect()} == want


def test_ranks_kept_in_the_stream(spark, many_files):
    units = live.trailing_units(live.event_items(sources.event_stream(spark, many_files, files_per_trigger=1)), delay="40 days")
    got = runner.run_top(units, ["until"], ["product_id"], "total_sold", 3)
    batch = live.hottest(live.trailing_units(live.event_items(testbed.events(spark, SF))), 3)
    assert table(got, "until", "product_id", "total_sold", "rank") == table(batch, "until", "product_id", "total_sold", "rank")


def loop(events, ttl, cooldown, attempts):
    state, out = {}, {}
    for eid, key, ts, kind, correct in sorted(events, key=lambda e: (e[2], e[0])):
        now, code = int(ts.timestamp()), state.get(key)
        if kind == "request":
            if code and now - code[0] < cooldown:
                out[eid] = "refused"
            else:
                out[eid], state[key] = "sent", [now, 0]
        elif not code:
            out[eid] = "none"
        elif code[0] + ttl < now:
            out[eid] = "expired"
            del state[key]
        elif code[1] >= attempts:
            out[eid] = "too many"
            del state[key]
        elif not correct:
            out[eid] = "wrong"
            code[1] += 1
        else:
            out[eid] = "ok"
            del state[key]
    return out


def test_codes_over_several_batches(spark, tmp_path):
    rnd = random.Random(9)
    start, rows = datetime(2024, 1, 1), []
    for i in range(400):
        ts = start + timedelta(seconds=i * 37 + rnd.randrange(30))
        rows.append((i, rnd.randrange(6), ts, rnd.choice(["request", "check", "check"]), rnd.random() < 0.3))
    schema = "event_id long, identifier long, ts timestamp, kind string, correct boolean"
    for n in range(4):
        spark.createDataFrame(rows[n * 100:(n + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
        .withColumn("purpose", F.lit("register")).withWatermark("ts", "1 hour")
    )
    got = {r.event_id: r.outcome for r in runner.run_available(codes.code_outcomes(stream), mode="append").collect()}
    assert got == loop(rows, codes.TTL_SECONDS, codes.COOLDOWN_SECONDS, codes.MAX_ATTEMPTS)
    assert set(got.values()) >= {"sent", "refused", "none", "wrong", "ok"}


def test_codes_followed_over_several_batches(spark, tmp_path):
    """The same in a merged table: outcomes of a loop, and the codes that it holds at the end; expired ones go."""
    rnd = random.Random(11)
    start, rows = datetime(2024, 1, 1), []
    for i in range(600):
        ts = start + timedelta(seconds=i * 37 + rnd.randrange(30) + (90_000 if i >= 450 else 0))
        rows.append((i, rnd.choice([None, *range(5)]) if i < 450 else 0, ts, rnd.choice(["request", "check", "check"]), rnd.random() < 0.3))
    schema = "event_id long, identifier long, ts timestamp, kind string, correct boolean"
    for n in range(4):
        spark.createDataFrame(rows[n * 150:(n + 1) * 150], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(999, 1, None, "check", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        .withColumn("purpose", F.lit("register"))
    )
    held, outcomes = codes.follow_codes(stream, folder=str(tmp_path / "table"), buckets=1)
    assert {r.event_id: r.outcome for r in outcomes.collect()} == loop(rows, codes.TTL_SECONDS, codes.COOLDOWN_SECONDS, codes.MAX_ATTEMPTS)
    assert outcomes.count() == 600
    assert {r.identifier for r in held.collect()} <= {0}


def test_codes_of_one_busy_key_need_an_arrow_batch():
    """Ten times the events of one key; what is held at a time is a batch."""
    schema = pa.schema([
        ("identifier", pa.int64()), ("purpose", pa.string()), ("event_id", pa.int64()), ("at", pa.int64()), ("kind", pa.string()),
        ("correct", pa.bool_()), ("outcome", pa.string()), ("created_at", pa.int64()), ("expires_at", pa.int64()),
        ("attempts", pa.int32()), ("_bucket", pa.int32()), ("_batch", pa.bool_())])

    def arriving(n, each=10_000):
        for begin in range(0, n, each):
            yield pa.RecordBatch.from_pylist([
                {"identifier": 1, "purpose": "p", "event_id": i, "at": i * 7_000_000, "kind": "check" if i % 3 else "request",
                 "correct": i % 5 == 0, "_bucket": 0, "_batch": True} for i in range(begin, min(n, begin + each))], schema=schema)

    def peak(n):
        tracemalloc.start()
        seen = sum(b.num_rows for b in codes._walk(arriving(n), 0, 600, 60, 5))
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return seen, used

    few, many = peak(30_000), peak(300_000)
    assert many[0] >= 300_000 and many[1] < 1.2 * few[1]


def in_files(df, at, folder, n=5):
    """The rows in n files by time, oldest first, read as a stream of one file a batch."""
    for i in range(n):
        part = df.where(F.floor((F.dayofmonth(at) - 1) / 6) == i)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


REPORT = "shift_id opening_cash transaction_count total_sales total_discount total_balance_due payments cash_collected cash_out_total expected_cash".split()


def test_shift_reports_with_late_payments(spark, tmp_path):
    shop = testbed.daybook(spark, SF)
    closed = shop.pos_shifts.where("status = 'closed'")
    late = shop.sale_payments.join(shop.sales.selectExpr("id as sale_id", "shift_id as sold_in"), "sale_id")
    assert late.where("shift_id <> sold_in").count() > 20
    stream = shifts.entries(
        in_files(shop.pos_shifts.select("id", "opening_cash", "opened_at"), "opened_at", tmp_path / "openings"),
        in_files(shop.sales, "created_at", tmp_path / "sales"),
        in_files(shop.sale_payments, "created_at", tmp_path / "payments"),
        in_files(shop.cash_movements, "created_at", tmp_path / "cash"),
        in_files(closed.select("id", "closing_cash", "closed_at"), F.date_sub("closed_at", 1), tmp_path / "closings"),
        reach="40 days",
    )
    kept, left = shifts.follow(stream, folder=str(tmp_path / "table"), buckets=2)
    got = shifts.reports(kept, left)
    assert table(got.where("status = 'open'"), *REPORT) == table(daybook.x_report(shop), *REPORT)
    figures = ["shift_id", "cash_collected", "cash_out_total", "expected_cash"]
    assert table(got, *figures, "status") == table(daybook.expected_cash(shop), *figures, "status")
    assert table(got.where("status = 'closed'"), "shift_id", "variance") == table(daybook.shift_variance(shop), "shift_id", "variance")
    # what is still held: shifts that are open or closed within a day and the bucket's newest event
    newest = shop.sales.agg(F.max("created_at")).scalar()
    recent = closed.where(F.col("closed_at") >= F.lit(newest) - F.expr("interval 3 days")).count()
    assert kept.select("shift_id").distinct().count() <= recent + got.where("status = 'open'").count()
    handed_over = left.where("closed_at is not null").select("shift_id")
    assert handed_over.count() == handed_over.distinct().count() > 200


def test_late_entries_correct_what_was_handed_over(spark, make, tmp_path):
    def add(n, **tables):
        for name, (columns, rows) in tables.items():
            make(columns, "", *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    kinds = {
        "openings": "id bigint, opening_cash decimal(10,2), opened_at timestamp_ntz",
        "closings": "id bigint, closing_cash decimal(10,2), closed_at timestamp_ntz",
        "sales": "id bigint, shift_id bigint, status string, total_amount decimal(10,2), discount_amount decimal(10,2), balance_due decimal(10,2), created_at timestamp_ntz",
        "payments": "id bigint, sale_id bigint, shift_id bigint, amount decimal(10,2), method string, created_at timestamp_ntz",
        "cash": "id bigint, shift_id bigint, amount decimal(10,2), created_at timestamp_ntz",
    }

    def run(**rows):
        add(0, **{name: (kinds[name], rows.get(name, [])) for name in kinds})
        streams = [spark.readStream.schema(kinds[n]).parquet(f"{tmp_path}/{n}") for n in ("openings", "sales", "payments", "cash", "closings")]
        kept, left = shifts.follow(shifts.entries(*streams), folder=f"{tmp_path}/table", buckets=1)
        return kept, left, {r.shift_id: r for r in shifts.reports(kept, left).collect()}

    kept, left, got = run(
        openings=[(1, 100, "2024-01-01 08:00:00"), (2, 50, "2024-01-02 08:00:00")],
        sales=[(1, 1, "completed", 30, 0, 10, "2024-01-01 09:00:00"), (2, 1, "voided", 5, 0, 0, "2024-01-01 09:30:00")],
        payments=[(1, 1, 1, 20, "cash", "2024-01-01 09:00:00"), (2, 2, 1, 5, "cash", "2024-01-01 09:30:00"), (3, 9, 1, 7, "cash", "2024-01-01 09:40:00")],
    )
    assert got[1].status == "open" and (got[1].cash_collected, got[1].expected_cash) == (20, 120)
    assert left.count() == 0 and got[2].payments == []
    # paid in the second shift towards a sale of the first, which closes
    kept, left, got = run(
        payments=[(4, 1, 2, 4, "cash", "2024-01-02 10:00:00"), (5, 1, 2, 6, "card", "2024-01-02 10:00:00")],
        closings=[(1, 118, "2024-01-01 18:00:00")],
        cash=[(1, 2, 3, "2024-01-02 19:00:00")],
    )
    assert (got[1].status, got[1].variance, got[1].total_balance_due) == ("closed", -2, 10)
    assert [tuple(p) for p in got[2].payments] == [("card", 6), ("cash", 4)] and got[2].expected_cash == 51
    assert {r.shift_id for r in kept.collect()} == {2} and {r.shift_id for r in left.collect()} == {1}
    # too late for the open table, and then the other one closes too: the bucket is empty
    kept, left, got = run(cash=[(2, 1, 8, "2024-01-01 12:00:00")])
    assert got[1].cash_out_total == 8 and {r.shift_id for r in kept.collect()} == {2}
    kept, left, got = run(closings=[(2, 51, "2024-01-02 20:00:00")], cash=[(3, 2, 0, "2024-01-04 20:00:00")])
    assert kept.count() == 0 and got[2].variance == 0
    kept, left, got = run(openings=[(3, 10, "2024-01-05 08:00:00")])
    assert kept.count() == 1 and sorted(got) == [1, 2, 3]


def test_sessions_leave_when_over(spark, many_files, tmp_path):
    events = testbed.events(spark, SF)
    stream = sources.event_stream(spark, many_files, files_per_trigger=1)
    going_on, over = shifts.sessions(stream, folder=str(tmp_path), buckets=2)
    assert table(going_on.unionByName(over)) == table(live.working_sessions(events))
    last = events.agg(F.max("ts")).scalar()
    assert 0 < going_on.count() < over.count() and going_on.where(F.col("closed_at") < F.lit(last) - F.expr("interval 2 days")).count() == 0


def test_sessions_meet_at_the_gap(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, at + timedelta(minutes=m)) for m in (0, 240, 481, 481, 700)] + [(2, at)]
    for n, part in enumerate((rows[2:4], rows[:2] + rows[4:])):  # the second batch comes before the first one's events
        spark.createDataFrame(part, "staff_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("staff_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    going_on, over = shifts.sessions(stream, folder=f"{tmp_path}/table")
    batch = live.working_sessions(spark.createDataFrame(rows, "staff_id long, ts timestamp"))
    assert over.count() == 0 and table(going_on) == table(batch)
    assert [r[3] for r in table(going_on)] == [2, 3, 1]
