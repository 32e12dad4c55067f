from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tests.conftest import table
from tillbook.plans import daybook, lifecycle

FROM, TO = "2024-01-01", "2024-01-03"


@pytest.fixture(scope="module")
def shop(make, shop_of):
    return shop_of(
        users=make("users", "id name", (1, "Ann"), (2, "Bob")),
        pos_shifts=make("pos_shifts", "id staff_id opening_cash opened_at closing_cash closed_at status",
                        (1, 1, 100, "2024-01-01 08:00:00", 150, "2024-01-01 18:00:00", "closed"),
                        (2, 1, 50, "2024-01-02 08:00:00", None, None, "open"),
                        (3, 2, 10, "2024-01-02 09:00:00", None, None, "open"),
                        (4, 2, 20, "2024-01-03 00:00:00", None, None, "open")),
        sales=make("sales", "id shift_id staff_id total_amount discount_amount balance_due payment_method status created_at",
                   (1, 1, 1, 60, 5, 20, "cash", "completed", "2024-01-01 23:59:59"),
                   (2, 1, 1, 30, 0, 0, "card", "voided", "2024-01-01 12:00:00"),
                   (3, 2, 1, 25, 1, 0, "cash", "completed", "2024-01-03 00:00:00"),
                   (4, 2, 1, 10, 0, 0, "cash", "returned", "2024-01-03 10:00:00"),
                   (5, 2, 1, 99, 0, 0, "cash", "completed", "2024-01-04 00:00:00")),
        sale_payments=make("sale_payments", "id sale_id shift_id staff_id amount method created_at",
                           (1, 1, 1, 1, 40, "cash", "2024-01-01 23:59:59"),
                           (2, 2, 1, 1, 30, "card", "2024-01-01 12:00:00"),
                           (3, 1, 2, 1, 20, "cash", "2024-01-02 09:00:00"),
                           (4, 3, 2, 1, 25, "card", "2024-01-03 00:00:00")),
        cash_movements=make("cash_movements", "id shift_id staff_id amount reason created_at",
                            (1, 1, 1, 15, "Lunch", "2024-01-01 13:00:00"),
                            (2, 2, 1, 60, "Salary", "2024-01-02 08:30:00"),
                            (3, 2, 1, 45, "Other", "2024-01-02 12:00:00")),
    )


def test_totals_count_each_status_once(shop):
    assert table(daybook.z_totals(shop, FROM, TO)) == [(2, 85.0, 6.0, 20.0, 1, 1)]


def test_days_add_up_to_the_totals(shop):
    both = daybook.totals_and_days(shop, FROM, TO)
    total = table(both.where("day is null").drop("day"))[0]
    days = table(both.where("day is not null").drop("day"))
    assert total == tuple(sum(c) for c in zip(*days))


def test_day_with_only_a_cash_out_is_missing_unless_by_calendar(shop):
    by_sales = daybook.z_days(shop, FROM, TO)
    assert [str(r.day) for r in by_sales.collect()] == ["2024-01-03", "2024-01-01"]
    calendar = {str(r.day): float(r.total_cash_out) for r in daybook.z_days(shop, FROM, TO, mode="calendar").collect()}
    assert calendar == {"2024-01-01": 15.0, "2024-01-02": 105.0, "2024-01-03": 0.0}


def test_late_payment_counts_on_its_own_day(shop):
    assert table(daybook.z_payments(shop, "2024-01-02", "2024-01-02")) == [("cash", 20.0)]
    assert table(daybook.z_payments(shop, FROM, TO)) == [("card", 25.0), ("cash", 60.0)]


def test_staff_scope(shop):
    assert table(daybook.z_totals(shop, FROM, TO, staff_id=2)) == [(0, 0.0, 0.0, 0.0, 0, 0)]


def test_expected_cash_is_opening_plus_in_minus_out(shop):
    got = {r.shift_id: float(r.expected_cash) for r in daybook.expected_cash(shop).collect()}
    assert got == {1: 125.0, 2: -35.0, 3: 10.0, 4: 20.0}
    assert table(daybook.shift_variance(shop), "shift_id", "variance") == [(1, 25.0)]


def test_x_report_lists_open_shifts_even_without_sales(shop):
    rows = {r.shift_id: r for r in daybook.x_report(shop).collect()}
    assert set(rows) == {2, 3, 4}
    assert rows[3].transaction_count == 0 and rows[3].payments == []
    assert [(p.method, float(p.total)) for p in rows[2].payments] == [("card", 25.0), ("cash", 20.0)]
    assert rows[2].transaction_count == 2 and float(rows[2].cash_out_total) == 105.0


def test_current_shift_and_double_shifts(shop):
    assert table(daybook.current_shift(shop), "staff_id", "id") == [(1, 2), (2, 4)]
    assert table(daybook.double_open_shifts(shop)) == [(2, 2, 3)]


def test_overdrawn_cash_out_is_flagged_and_refused(shop):
    flagged = table(daybook.overdrawn_cash_outs(shop), "id", "short_by")
    assert flagged == [(2, 10.0), (3, 35.0)]
    settled = {(r.kind, r.id): r.admitted for r in daybook.settled_cash_events(shop).collect()}
    # 60 does not fit into 50; refusing it leaves 70 at noon, so 45 fits
    assert settled[("out", 2)] is False and settled[("out", 3)] is True and settled[("in", 3)] is True


def test_shifts_in_range_carry_their_cash_out(shop):
    rows = table(daybook.z_shifts(shop, FROM, "2024-01-02"), "id", "staff_name", "cash_out_total")
    assert rows == [(1, "Ann", 15.0), (2, "Ann", 105.0), (3, "Bob", 0.0)]


def test_closing_reads_movements_of_shifts_without_kept_totals_only(shop, make):
    counted = make("shift_id long, counted_cash decimal(10,2), counted_at timestamp_ntz", "", (2, 50, "2024-01-05 10:00:00"))
    plain = lifecycle.close_shifts(shop, counted)
    closed = [r.id for r in shop.pos_shifts.where("status = 'closed'").collect()]
    open_now = [r.id for r in shop.pos_shifts.where("status = 'open'").collect()]
    assert closed and open_now
    sums = {r.shift_id: r.cash_out_total for r in daybook.cash_out_per_shift(shop).collect()}
    # an open shift's total is not taken from those kept
    kept = make("shift_id long, cash_out_total decimal(20,2)", "", *((i, sums.get(i, 0)) for i in closed), *((i, 999) for i in open_now))
    only_open = shop.replace(cash_movements=shop.cash_movements.where(~F.col("shift_id").isin(closed)))
    assert table(lifecycle.close_shifts(only_open, counted, kept)) == table(plain)
    assert table(lifecycle.close_shifts(shop, counted, kept.limit(0))) == table(plain)
