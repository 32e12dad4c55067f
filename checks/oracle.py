"""DuckDB statements the registered queries must match, value by value."""

from __future__ import annotations

from checks.views import cents, day, stamp, with_views

ORACLE: dict[str, str] = {}


def check(name: str, body: str, extra: str = "", recursive: bool = False) -> None:
    ORACLE[name] = with_views(body, extra, recursive)


AS_OF = "timestamp '2001-08-01'"
FROM, TO = "date '2024-01-01'", "date '2024-01-30'"
PRODUCT = (
    "id, name, slug, product_code, " + cents("sale_price", "sale_price") + ", "
    + cents("discount_price", "discount_price") + ", stock"
)
NAMES4 = "category_name, category_slug, subcategory_name, subcategory_slug"

# --- rankings ---------------------------------------------------------------

check("combined_items", f"SELECT product_id, quantity, {stamp('created_at', 'created_at')} FROM sh_combined")
check(
    "units_by_entity",
    """SELECT p.category_id, p.subcategory_id, p.id AS product_id, cast(sum(ci.quantity) AS bigint) AS total_sold
       FROM sh_combined ci JOIN sh_products p ON p.id = ci.product_id
       GROUP BY ROLLUP (p.category_id, p.subcategory_id, p.id)""",
)


def _top(days: str, where: str, limit: int) -> str:
    return f"""SELECT p.*, t.total_sold FROM sh_named p JOIN (
            SELECT product_id, cast(sum(quantity) AS bigint) AS total_sold FROM sh_combined
            WHERE {days} GROUP BY 1) t ON t.product_id = p.id
        WHERE p.is_active = 1 AND {where} ORDER BY total_sold DESC, p.id LIMIT {limit}"""


WEEK = f"created_at >= {AS_OF} - INTERVAL 7 DAY"
check("best_selling", f"SELECT {PRODUCT}, {NAMES4}, total_sold FROM ({_top('true', 'p.stock > 0', 5)})")
check(
    "featured_products",
    f"SELECT {PRODUCT}, category_name, subcategory_name, total_sold FROM ({_top(WEEK, 'p.stock > 0', 3)})",
)
check(
    "top_k_or_fallback",
    f"""SELECT {PRODUCT}, category_name, cast(NULL AS varchar) AS subcategory_name, cast(NULL AS bigint) AS total_sold
        FROM sh_named WHERE is_active = 1 AND featured = 1 AND stock > 0
          AND NOT EXISTS (SELECT 1 FROM sh_combined WHERE created_at >= timestamp '2001-12-25')
        ORDER BY created_at DESC, id LIMIT 3""",
)
check("net_units", """SELECT product_id, cast(sum(net) AS bigint) AS total_sold FROM (
        SELECT l.product_id, greatest(0, l.quantity - l.returned_quantity) AS net
        FROM sh_lines l JOIN sh_orders h ON h.id = l.parent_id WHERE h.status = 'successful'
        UNION ALL SELECT l.product_id, greatest(0, l.quantity - l.returned_quantity)
        FROM sh_lines l JOIN sh_sales h ON h.id = l.parent_id WHERE h.status = 'completed') GROUP BY 1""")


def _hot(dim: str, key: str, cols: str) -> str:
    return f"""SELECT {cols}, {stamp('g.created_at', 'created_at')}, cast(sum(ci.quantity) AS bigint) AS total_sold
        FROM {dim} g JOIN sh_products p ON p.{key} = g.id JOIN sh_combined ci ON ci.product_id = p.id
        WHERE g.is_active = 1 AND ci.created_at >= {AS_OF} - INTERVAL 7 DAY
        GROUP BY {cols}, g.created_at ORDER BY total_sold DESC, g.id LIMIT 10"""


CAT, SUB = "g.id, g.name, g.slug, g.is_active", "g.id, g.category_id, g.name, g.slug, g.is_active"
check("hot_categories", _hot("sh_categories", "category_id", CAT))
check("hot_subcategories", _hot("sh_subcategories", "subcategory_id", SUB))
# from a table per day; the rows are the same
for name, same in (
    ("featured_from_days", "featured_products"), ("hot_categories_from_days", "hot_categories"),
    ("hot_subcategories_from_days", "hot_subcategories"),
):
    ORACLE[name] = ORACLE[same]
check(
    "featured_categories_ranked",
    f"""SELECT {CAT}, {stamp('g.created_at', 'created_at')},
               cast(coalesce(sum(ci.quantity), 0) AS bigint) AS total_sold
        FROM sh_categories g LEFT JOIN sh_products p ON p.category_id = g.id
        LEFT JOIN sh_combined ci ON ci.product_id = p.id
        WHERE g.is_active = 1 GROUP BY {CAT}, g.created_at""",
)

# --- dashboard --------------------------------------------------------------

EARNED = """SELECT created_at, total_amount FROM sh_orders WHERE status = 'successful' AND customer_id IS NOT NULL
            UNION ALL SELECT created_at, total_amount FROM sh_sales WHERE status = 'completed'"""
check("dash_revenue", f"SELECT {cents('coalesce(sum(total_amount), 0)', 'revenue')} FROM ({EARNED})")
check("dash_counts", """SELECT (SELECT count(*) FROM sh_orders WHERE customer_id IS NOT NULL) AS order_count,
        (SELECT count(*) FROM sh_products WHERE is_active = 1) AS product_count,
        (SELECT count(*) FROM sh_customers) AS customer_count""")
check("dash_revenue_by_day", f"""SELECT {day('created_at')}, {cents('sum(total_amount)', 'revenue')} FROM ({EARNED})
        WHERE created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""")
check("dash_status_breakdown", "SELECT status, count(*) AS count FROM sh_orders WHERE customer_id IS NOT NULL GROUP BY 1")
check("dash_top_products", f"SELECT {PRODUCT}, category_name, category_slug, total_sold FROM ({_top('true', 'true', 10)})")


def _zero(dim: str, key: str) -> str:
    return f"""SELECT g.id, g.name, cast(coalesce(sum(ci.quantity), 0) AS bigint) AS total_sold
        FROM {dim} g LEFT JOIN sh_products p ON p.{key} = g.id LEFT JOIN sh_combined ci ON ci.product_id = p.id
        WHERE g.is_active = 1 GROUP BY g.id, g.name ORDER BY total_sold DESC, g.name, g.id LIMIT 5"""


check("dash_top_categories", _zero("sh_categories", "category_id"))
check("dash_top_subcategories", _zero("sh_subcategories", "subcategory_id"))
check("dash_recent_orders", f"""SELECT o.id, {cents('o.total_amount', 'total_amount')}, o.status,
        {stamp('o.created_at', 'created_at')}, c.name AS customer_name
        FROM sh_orders o JOIN sh_customers c ON c.id = o.customer_id
        ORDER BY o.created_at DESC, o.id DESC LIMIT 10""")

# --- wholesale --------------------------------------------------------------

check("seller_totals", f"""SELECT
        (SELECT {cents('coalesce(sum(l.quantity * p.purchase_price), 0)', 'x')} FROM sh_lines l
           JOIN sh_seller_orders o ON o.id = l.parent_id JOIN sh_products p ON p.id = l.product_id
          WHERE o.status = 'successful') AS total_cost,
        (SELECT cast(coalesce(sum(l.quantity), 0) AS bigint) FROM sh_lines l
           JOIN sh_seller_orders o ON o.id = l.parent_id WHERE o.status = 'successful') AS units_sold,
        (SELECT count(*) FROM sh_seller_orders WHERE status = 'successful') AS order_count,
        (SELECT count(*) FROM sh_products WHERE is_active = 1) AS product_count""")
check("seller_cost_by_day", f"""SELECT {day('o.created_at')}, {cents('sum(l.quantity * p.purchase_price)', 'cost')}
        FROM sh_lines l JOIN sh_seller_orders o ON o.id = l.parent_id JOIN sh_products p ON p.id = l.product_id
        WHERE o.status = 'successful' AND o.created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""")
check("seller_top_products", f"""SELECT p.id, p.name, p.product_code, {cents('p.purchase_price', 'purchase_price')},
        p.category_name, cast(sum(l.quantity) AS bigint) AS total_sold,
        {cents('sum(l.quantity * p.purchase_price)', 'total_cost')}
        FROM sh_named p JOIN sh_lines l ON l.product_id = p.id JOIN sh_seller_orders o ON o.id = l.parent_id
        WHERE p.is_active = 1 AND o.status = 'successful'
        GROUP BY p.id, p.name, p.product_code, p.purchase_price, p.category_name
        ORDER BY total_sold DESC, p.id LIMIT 10""")
check("seller_status", "SELECT status, count(*) AS count FROM sh_seller_orders GROUP BY 1")

# --- day book ---------------------------------------------------------------

FIGURES = f"""count(*) FILTER (status = 'completed') AS transaction_count,
    {cents("coalesce(sum(total_amount) FILTER (status = 'completed'), 0)", 'total_sales')},
    {cents("coalesce(sum(discount_amount) FILTER (status = 'completed'), 0)", 'total_discount')},
    {cents("coalesce(sum(balance_due) FILTER (status = 'completed'), 0)", 'total_balance_due')},
    count(*) FILTER (status = 'voided') AS voided_count, count(*) FILTER (status = 'returned') AS returned_count"""
RANGE = f"cast(created_at AS date) BETWEEN {FROM} AND {TO}"
check("z_totals", f"SELECT {FIGURES} FROM bk_sales WHERE {RANGE}")
check("totals_and_days", f"""SELECT cast(d AS varchar) AS day, {FIGURES}
        FROM (SELECT *, cast(created_at AS date) AS d FROM bk_sales) WHERE {RANGE} GROUP BY ROLLUP (d)""")
check("z_payments", f"""SELECT p.method, {cents('sum(p.amount)', 'total')} FROM bk_valid p
        WHERE cast(p.created_at AS date) BETWEEN {FROM} AND {TO} GROUP BY 1""")
check("z_days", f"""SELECT cast(f.d AS varchar) AS day, f.* EXCLUDE (d), {cents('coalesce(m.t, 0)', 'total_cash_out')}
        FROM (SELECT cast(created_at AS date) AS d, {FIGURES} FROM bk_sales WHERE {RANGE} GROUP BY 1) f
        LEFT JOIN (SELECT cast(created_at AS date) AS d, sum(amount) AS t FROM bk_cash GROUP BY 1) m ON m.d = f.d""")
SPINE = "(SELECT cast(unnest(generate_series(date '2023-12-28', date '2024-02-02', INTERVAL 1 DAY)) AS date) AS d)"
check("z_days_calendar", f"""SELECT cast(s.d AS varchar) AS day,
        coalesce(transaction_count, 0) AS transaction_count, coalesce(total_sales, 0) AS total_sales,
        coalesce(total_discount, 0) AS total_discount, coalesce(total_balance_due, 0) AS total_balance_due,
        coalesce(voided_count, 0) AS voided_count, coalesce(returned_count, 0) AS returned_count,
        {cents('coalesce(m.t, 0)', 'total_cash_out')}
        FROM {SPINE} s
        LEFT JOIN (SELECT cast(created_at AS date) AS d, {FIGURES} FROM bk_sales GROUP BY 1) f ON f.d = s.d
        LEFT JOIN (SELECT cast(created_at AS date) AS d, sum(amount) AS t FROM bk_cash GROUP BY 1) m ON m.d = s.d""")
check("date_spine", f"""SELECT cast(s.d AS varchar) AS day, coalesce(n, 0) AS sales FROM {SPINE} s
        LEFT JOIN (SELECT cast(created_at AS date) AS d, count(*) AS n FROM bk_sales GROUP BY 1) f ON f.d = s.d""")
SHIFT = f"""h.id, h.staff_id, {cents('h.opening_cash', 'opening_cash')}, {stamp('h.opened_at', 'opened_at')},
        {cents('h.closing_cash', 'closing_cash')}, {stamp('h.closed_at', 'closed_at')}, h.status"""
check("z_shifts", f"""SELECT {SHIFT}, u.name AS staff_name, {cents('h.cash_out_total', 'cash_out_total')}
        FROM bk_expected h JOIN sh_users u ON u.id = h.staff_id
        WHERE cast(h.opened_at AS date) BETWEEN {FROM} AND {TO}""")
check("staff_sales", f"""SELECT {day('s.created_at')}, s.staff_id, u.name AS staff_name, count(*) AS transaction_count,
        {cents('sum(total_amount)', 'total_sales')}, {cents('sum(discount_amount)', 'total_discount')}
        FROM bk_sales s JOIN sh_users u ON u.id = s.staff_id
        WHERE s.status = 'completed' AND cast(s.created_at AS date) BETWEEN {FROM} AND {TO} GROUP BY 1, 2, 3""")
check("sum_per_shift", f"SELECT id, {cents('cash_out_total', 'cash_out_total')} FROM bk_expected")
check("payment_breakdown", f"SELECT shift_id, method, {cents('sum(amount)', 'total')} FROM bk_valid GROUP BY 1, 2")
check("expected_cash", f"""SELECT id AS shift_id, staff_id, status, {cents('opening_cash', 'opening_cash')},
        {stamp('opened_at', 'opened_at')}, {cents('closing_cash', 'closing_cash')}, {stamp('closed_at', 'closed_at')},
        {cents('cash_collected', 'cash_collected')}, {cents('cash_out_total', 'cash_out_total')},
        {cents('expected_cash', 'expected_cash')} FROM bk_expected""")
check("shift_variance", f"""SELECT id AS shift_id, staff_id, {cents('closing_cash', 'closing_cash')},
        {cents('expected_cash', 'expected_cash')}, {cents('closing_cash - expected_cash', 'variance')}
        FROM bk_expected WHERE status = 'closed'""")
check("x_report", f"""SELECT h.id AS shift_id, h.staff_id, u.name AS staff_name, {stamp('h.opened_at', 'opened_at')},
        {cents('h.opening_cash', 'opening_cash')}, coalesce(f.n, 0) AS transaction_count,
        {cents('coalesce(f.t, 0)', 'total_sales')}, {cents('coalesce(f.dis, 0)', 'total_discount')},
        {cents('coalesce(f.b, 0)', 'total_balance_due')}, coalesce(p.payments, '') AS payments,
        {cents('h.cash_collected', 'cash_collected')}, {cents('h.cash_out_total', 'cash_out_total')},
        {cents('h.expected_cash', 'expected_cash')}
        FROM bk_expected h JOIN sh_users u ON u.id = h.staff_id
        LEFT JOIN (SELECT shift_id, count(*) AS n, sum(total_amount) AS t, sum(discount_amount) AS dis,
                          sum(balance_due) AS b FROM bk_sales WHERE status = 'completed' GROUP BY 1) f ON f.shift_id = h.id
        LEFT JOIN (SELECT shift_id, string_agg(method || ':' || cast(round(t * 100) AS bigint), '|' ORDER BY method) AS payments
                   FROM (SELECT shift_id, method, sum(amount) AS t FROM bk_valid GROUP BY 1, 2) GROUP BY 1) p
               ON p.shift_id = h.id
        WHERE h.status = 'open'""")
check("current_per_key", f"""SELECT staff_id, id, {stamp('opened_at', 'opened_at')}, {cents('opening_cash', 'opening_cash')}
        FROM (SELECT *, row_number() OVER (PARTITION BY staff_id ORDER BY opened_at DESC, id DESC) AS rn
              FROM bk_shifts WHERE status = 'open') WHERE rn = 1""")
check("one_open_shift", """SELECT staff_id, count(*) AS open_shifts, min(id) AS first_shift FROM bk_shifts
        GROUP BY 1 HAVING count(*) > 1""")
check("cash_outs_list", f"""SELECT m.id, m.shift_id, m.staff_id, {cents('m.amount', 'amount')}, m.reason, m.note,
        {stamp('m.created_at', 'created_at')}, u.name AS staff_name
        FROM bk_cash m JOIN sh_users u ON u.id = m.staff_id""")
BALANCE = """SELECT e.*, h.opening_cash + sum(delta) OVER (PARTITION BY shift_id ORDER BY created_at, kind, id
                  ROWS UNBOUNDED PRECEDING) AS balance
        FROM (SELECT shift_id, created_at, 'in' AS kind, id, amount AS delta FROM bk_valid WHERE method = 'cash'
              UNION ALL SELECT shift_id, created_at, 'out', id, -amount FROM bk_cash) e
        JOIN (SELECT id AS hid, opening_cash FROM bk_shifts) h ON h.hid = e.shift_id"""
BALCOLS = f"shift_id, {stamp('created_at', 'created_at')}, kind, id, {cents('delta', 'delta')}, {cents('balance', 'balance')}"
check("shift_cash_balance", f"SELECT {BALCOLS} FROM ({BALANCE})")
check("cash_out_overdraw", f"""SELECT {BALCOLS}, {cents('-balance', 'short_by')}
        FROM ({BALANCE.replace('h.opening_cash + ', '')}) WHERE kind = 'out' AND balance < 0""")
check("cash_out_decisions", """SELECT key AS shift_id, kind, ref AS id, delta, cast(ok AS int) AS admitted FROM walk""",
      recursive=True, extra="""req AS MATERIALIZED (
            SELECT shift_id AS key, kind, id AS ref, cast(round(delta * 100) AS bigint) AS delta,
                   row_number() OVER (PARTITION BY shift_id ORDER BY created_at, kind, id) AS rn
            FROM (SELECT shift_id, created_at, 'in' AS kind, id, amount AS delta FROM bk_valid WHERE method = 'cash'
                  UNION ALL SELECT shift_id, created_at, 'out', id, -amount FROM bk_cash)),
        walk AS (SELECT key, kind, ref, delta, rn, delta >= 0 AS ok, greatest(delta, 0) AS till FROM req WHERE rn = 1
            UNION ALL
            SELECT r.key, r.kind, r.ref, r.delta, r.rn, w.till + r.delta >= 0,
                   CASE WHEN w.till + r.delta >= 0 THEN w.till + r.delta ELSE w.till END
            FROM walk w JOIN req r ON r.key = w.key AND r.rn = w.rn + 1)""")

# --- scans, sources, sinks --------------------------------------------------

P_ALL = (
    "id, category_id, subcategory_id, name, slug, product_code, "
    + ", ".join(cents(c, c) for c in ("sale_price", "discount_percent", "purchase_price", "discount_price"))
    + f", stock, featured, is_active, {stamp('created_at', 'created_at')}"
)
check("scan_active", f"""SELECT id, name, slug, is_active, {stamp('created_at', 'created_at')}
        FROM sh_categories WHERE is_active = 1""")
check("scan_ordered_small", """SELECT n_nationkey AS id, n_name AS name,
        n_name || ':wght@' || n_regionkey AS family_param FROM nation""")
check("point_lookup", """SELECT id, slug, name, category_name, subcategory_name FROM sh_named
        WHERE is_active = 1 AND id IN (SELECT product_id FROM sh_lines WHERE returned_quantity > 0)""")
check("bound_parameters", """SELECT status, count(*) AS n FROM sh_orders
        WHERE status IN ('successful', 'return') AND created_at >= timestamp '1996-01-01' GROUP BY 1""")
check("literal_rows", "SELECT r.id, r.name, (SELECT count(*) FROM sh_users u WHERE u.role_id = r.id) AS users FROM sh_roles r")
check("append_rows", f"SELECT status, count(*) AS n, {cents('sum(total_amount)', 'total')} FROM sh_orders GROUP BY 1")
check("truncate_reload", f"""SELECT status, count(*) AS n, {cents('sum(total_amount)', 'total')} FROM sh_orders
        WHERE status <> 'pending' OR customer_id IS NOT NULL GROUP BY 1""")
check("insert_select_backfill", f"""SELECT id AS sale_id, shift_id, staff_id, {cents('total_amount', 'amount')},
        payment_method AS method, {stamp('created_at', 'created_at')}, 'empty' AS target FROM bk_sales""")
check("upsert_latest", f"""SELECT identifier, purpose, payload, attempts, {stamp('ts', 'ts')} FROM (
        SELECT *, row_number() OVER (PARTITION BY identifier, purpose ORDER BY fresh DESC, ts DESC, payload DESC) AS rn
        FROM (SELECT user_id AS identifier, k % 3 AS purpose, event_id AS payload,
                     CASE WHEN event_type = 'view' THEN 0 ELSE k % 5 END AS attempts, ts,
                     cast(event_type = 'view' AS int) AS fresh
              FROM bk_events WHERE event_type IN ('view', 'signup'))) WHERE rn = 1""")
check("insert_missing", """SELECT whatsapp_number AS phone, id, name FROM sh_customers
        WHERE whatsapp_number NOT IN (SELECT phone FROM sh_users)""")
check("export_tables", "UNION ALL ".join(
    f"SELECT 'data_{n}_20240131_000000' AS file, count(*) AS n FROM {v} "
    for n, v in [("user_roles", "sh_roles"), ("users", "sh_users"), ("customers", "sh_customers"),
                 ("categories", "sh_categories"), ("subcategories", "sh_subcategories"),
                 ("products", "sh_products"), ("orders", "sh_orders"), ("order_items", "sh_lines")]))
check("json_column", "SELECT event_id, k, '{\"k\":' || k || '}' AS written FROM bk_events")


def fnv(expr: str) -> str:
    return (
        f"list_reduce(list_transform(string_split({expr}, ''), lambda c: cast(ascii(c) AS bigint)),"
        " lambda h, c: (xor(h, c) * 16777619) & 4294967295, cast(2166136261 AS bigint))"
    )


check("gen_topup_products", f"""
    SELECT category_id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || code AS slug,
           code AS product_code, cost * 100 AS purchase_price,
           cast(floor((cost * markup + 50) / 100) * 100 AS bigint) AS sale_price,
           CASE WHEN {fnv("code || ':discounted'")} % 10 < 3 THEN ({fnv("code || ':discount'")} % 3 + 1) * 500 ELSE 0 END
             AS discount_percent,
           cast({fnv("code || ':stock'")} % 56 + 5 AS int) AS stock,
           cast({fnv("code || ':featured'")} % 10 = 0 AS int) AS featured, 1 AS is_active
    FROM (SELECT *, {fnv("code || ':cost'")} % 14501 + 500 AS cost, {fnv("code || ':markup'")} % 31 + 130 AS markup
          FROM (SELECT category_id, cname || ' ' || w.words[cast((n + i) % len(w.words) AS int) + 1] AS name,
                       cast(greatest(2000, top + 1) + row_number() OVER (ORDER BY category_id, i) - 1 AS varchar) AS code
                FROM (SELECT s.category_id, s.cname, s.n, unnest(range(0, m.most - s.n)) AS i,
                             (SELECT max(cast(product_code AS bigint)) FROM sh_products
                              WHERE regexp_full_match(product_code, '[0-9]+')) AS top
                      FROM sizes s, (SELECT max(n) AS most FROM sizes) m),
                     (SELECT list(p_type ORDER BY p_type) AS words FROM (SELECT DISTINCT p_type FROM part)) w))""",
    extra="""sizes AS (SELECT c.id AS category_id, c.name AS cname, count(p.id) AS n
             FROM sh_categories c LEFT JOIN sh_products p ON p.category_id = c.id
             WHERE c.is_active = 1 GROUP BY 1, 2)""")


def chance(purpose: str, *keys: str) -> str:
    return fnv(f"'42:{purpose}:' || " + " || ':' || ".join(keys))


KEY = ("store_id", "ago", "n")
HISTORY = f"""
    stores AS (SELECT id AS store_id, unnest(range(0, 91)) AS ago FROM sh_users),
    tickets AS (SELECT store_id, ago, unnest(range(1, {chance('orders', 'store_id', 'ago')} % 6 + 2)) AS n FROM stores),
    heads AS (SELECT store_id || '-' || ago || '-' || n AS order_key, store_id,
            timestamp '2001-08-01' + to_minutes(cast({chance('hour', *KEY)} % 24 * 60 + {chance('minute', *KEY)} % 60
              - ago * 1440 AS int)) AS created_at,
            {chance('status', *KEY)} % 100 AS s, {chance('lines', *KEY)} % 3 + 1 AS n_lines,
            {chance('customer', *KEY)} % (SELECT count(*) FROM sh_customers) + 1 AS nth FROM tickets),
    people AS (SELECT id AS customer_id, row_number() OVER (ORDER BY id) AS nth FROM sh_customers),
    offer AS (SELECT *, cast(sum(w) OVER (ORDER BY id) AS bigint) AS upto
              FROM (SELECT *, {chance('popularity', 'id')} % 8 + 1 AS w FROM sh_products WHERE is_active = 1)),
    draws AS (SELECT order_key, n_lines, d,
            {chance('product', 'order_key', 'd')} % (SELECT max(upto) FROM offer) AS slot FROM heads, range(1, 65) t(d)),
    chosen AS (SELECT order_key, n_lines, id AS product_id, min(d) AS d FROM draws
               JOIN offer ON slot < upto AND slot >= upto - w GROUP BY 1, 2, 3),
    items AS (SELECT order_key, line_no, product_id, p.name AS product_name,
            CASE WHEN p.discount_percent > 0 THEN round(p.sale_price - p.sale_price * p.discount_percent * 0.01, 0)
                 ELSE p.sale_price END AS price,
            cast({chance('units', 'order_key', 'product_id')} % 3 + 1 AS int) AS quantity
        FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY d) AS line_no FROM chosen) c
        JOIN sh_products p ON p.id = c.product_id WHERE line_no <= n_lines)"""
check("gen_demo_orders", f"""SELECT h.order_key, h.store_id, p.customer_id, {cents('t.total', 'total_amount')},
        CASE WHEN s < 75 THEN 'successful' WHEN s < 85 THEN 'pending' WHEN s < 93 THEN 'cancelled' ELSE 'return' END AS status,
        'cod' AS payment_method, {stamp('h.created_at', 'created_at')}
        FROM heads h JOIN people p ON p.nth = h.nth
        JOIN (SELECT order_key, sum(price * quantity) AS total FROM items GROUP BY 1) t ON t.order_key = h.order_key""",
      extra=HISTORY)
check("gen_demo_lines", f"""SELECT order_key, line_no, product_id, product_name, {cents('price', 'price')}, quantity
        FROM items""", extra=HISTORY)

# --- projections, filters, predicates ---------------------------------------

check("star_join", f"SELECT {P_ALL}, {NAMES4} FROM sh_named")
check("dynamic_filter", f"""SELECT id, staff_id, {cents('total_amount', 'total_amount')}, {stamp('created_at', 'created_at')}
        FROM bk_sales WHERE staff_id = 4 AND created_at BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-25'""")
check("not_equal", "SELECT id, status FROM bk_sales WHERE status != 'voided'")
check("in_list", "SELECT id, status FROM sh_orders WHERE status IN ('return', 'cancelled')")


def _search(p: str) -> str:
    return f"(name ILIKE '{p}' OR product_code ILIKE '{p}' OR category_name ILIKE '{p}' OR subcategory_name ILIKE '{p}')"


for _name in ("search_products", "search_products_indexed"):
    check(_name, f"""SELECT id, name, category_name, subcategory_name FROM sh_named
        WHERE is_active = 1 AND {_search('%RinG%')}""")
check("search_wildcards", f"SELECT id, name, product_code FROM sh_named WHERE is_active = 1 AND {_search('%r_d%w%')}")
CUST = f"id, name, email, whatsapp_number AS phone, is_active, {stamp('created_at', 'created_at')}"
for _name in ("search_customers", "search_customers_indexed"):
    check(_name, f"""SELECT {CUST} FROM sh_customers WHERE is_active = 1 AND whatsapp_number <> 'anonymous-guest'
        AND (name ILIKE '%0001%' OR whatsapp_number ILIKE '%0001%')""")
check("customers_all", f"SELECT {CUST} FROM sh_customers WHERE is_active = 0 AND whatsapp_number <> 'anonymous-guest'")
check("date_between", f"""SELECT id, {stamp('created_at', 'created_at')} FROM bk_sales
        WHERE cast(created_at AS date) BETWEEN date '2024-01-03' AND date '2024-01-28'""")
check("ts_range", f"""SELECT id, {stamp('created_at', 'created_at')} FROM bk_sales
        WHERE created_at >= timestamp '2024-01-03' AND created_at <= timestamp '2024-01-28'""")
check("trailing_days", f"SELECT id, {stamp('created_at', 'created_at')} FROM sh_orders WHERE created_at >= {AS_OF} - INTERVAL 30 DAY")
check("null_checks", "SELECT count(customer_id) AS retail, count(*) - count(customer_id) AS staff FROM sh_orders")
check("active_flag", """SELECT 'Admin' AS viewer, id, is_active FROM sh_products WHERE is_active = 0
        UNION ALL SELECT 'public', id, is_active FROM sh_products WHERE is_active = 1""")
check("stock_visibility", """SELECT count(*) FILTER (stock > 0) AS public, count(*) AS staff,
        count(*) FILTER (stock < 10) AS low FROM sh_products""")
check("low_stock", "SELECT id, name, stock, product_code FROM sh_products WHERE is_active = 1 AND stock < 10")
check("exclude_sentinels", """SELECT id, 'customer' AS kind FROM sh_customers WHERE whatsapp_number != 'anonymous-guest'
        UNION ALL SELECT id, 'staff' FROM sh_users WHERE email != 'anonymous-seller@internal.local'""")
check("regex_filter", "SELECT id, product_code FROM sh_products WHERE regexp_full_match(product_code, '[0-9]+')")
RETAIL3 = {"sale_price", "discount_percent", "discount_price"}


def _without(hidden: set[str], extra: str = "") -> str:
    plain = ["id", "category_id", "subcategory_id", "name", "slug", "product_code", "stock", "featured", "is_active"]
    priced = ["sale_price", "discount_percent", "purchase_price", "discount_price"]
    cols = [c for c in plain if c not in hidden] + [cents(c, c) for c in priced if c not in hidden]
    return ", ".join([*cols, stamp("created_at", "created_at")]) + extra


check("mask_product_seller", f"SELECT {_without({'product_code'} | RETAIL3)}, {NAMES4} FROM sh_named")
check("mask_product_staff", f"SELECT {_without(set())} FROM sh_products")
check("mask_analytics_staff", f"SELECT {_without({'product_code', 'purchase_price'})} FROM sh_products")
check("mask_wishlist_seller", f"SELECT {_without({'product_code'})} FROM sh_products")
check("mask_order_items_public", f"""SELECT id, parent_id AS order_id, line_no, product_id, product_name,
        {cents('price', 'price')}, quantity, returned_quantity FROM sh_lines""")
check("allowlist_projection", f"""SELECT id, slug, name, product_code, {cents('purchase_price', 'purchase_price')}, stock,
        {NAMES4} FROM sh_named WHERE is_active = 1""")
check("row_scope", """SELECT u.id, r.name AS role, CASE WHEN r.name = 'Staff'
          THEN (SELECT count(*) FROM bk_sales s WHERE s.staff_id = u.id) ELSE (SELECT count(*) FROM bk_sales) END AS visible
        FROM sh_users u JOIN sh_roles r ON r.id = u.role_id""")
check("domain_check", f"""SELECT id, {cents('amount', 'amount')}, reason, concat_ws(',',
        CASE WHEN amount <= 0 THEN 'amount' END,
        CASE WHEN reason = 'Other' AND (note IS NULL OR trim(note) = '') THEN 'note' END,
        CASE WHEN reason NOT IN ('Salary','Delivery','Collection','Lunch','Other') THEN 'reason' END) AS failed
        FROM bk_cash""")
check("product_rules", """SELECT id, stock, concat_ws(',',
        CASE WHEN discount_percent NOT BETWEEN 0 AND 100 THEN 'discount' END,
        CASE WHEN stock < 1 THEN 'stock' END) AS failed FROM sh_products
        WHERE stock < 1 OR discount_percent NOT BETWEEN 0 AND 100""")
check("valid_email", r"""SELECT id, email, cast(regexp_full_match(trim(email), '[^\s@]+@[^\s@]+\.[^\s@]+') AS int) AS valid
        FROM (SELECT id, coalesce(email, whatsapp_number) AS email FROM sh_customers
              UNION ALL SELECT id, ' ' || email FROM sh_users)""")

# --- joins ------------------------------------------------------------------

check("fact_header_join", f"""SELECT l.id, l.parent_id AS order_id, l.product_id, l.quantity,
        {stamp('o.created_at', 'created_at')} FROM sh_lines l JOIN sh_orders o ON o.id = l.parent_id
        WHERE o.status = 'successful'""")
check("dim_enrich", f"SELECT id, category_id, subcategory_id, {NAMES4} FROM sh_named")
check("staff_customer_enrich", """SELECT s.id, s.staff_id, u.name AS staff_name, s.customer_id, c.name AS customer_name
        FROM bk_sales s JOIN sh_users u ON u.id = s.staff_id LEFT JOIN sh_customers c ON c.id = s.customer_id""")
check("zero_preserving_rank", f"""SELECT g.id, g.name, cast(coalesce(sum(ci.quantity), 0) AS bigint) AS total_sold
        FROM sh_subcategories g LEFT JOIN sh_products p ON p.subcategory_id = g.id
        LEFT JOIN (SELECT * FROM sh_combined WHERE created_at >= {AS_OF} - INTERVAL 7 DAY) ci ON ci.product_id = p.id
        WHERE g.is_active = 1 GROUP BY 1, 2""")
check("role_filtered_join", f"SELECT id, user_id, status, {cents('total_amount', 'total_amount')} FROM sh_seller_orders")
PARTY = """FROM sh_orders o LEFT JOIN sh_users u ON u.id = o.user_id LEFT JOIN sh_roles r ON r.id = u.role_id
        LEFT JOIN sh_customers c ON c.id = o.customer_id"""
PARTY_COLS = """coalesce(u.name, c.name) AS customer_name, coalesce(u.email, c.email) AS customer_email,
        coalesce(u.phone, c.whatsapp_number) AS customer_phone,
        CASE WHEN o.customer_id IS NOT NULL THEN 'Customer' ELSE r.name END AS orderer_role"""
check("multi_party_coalesce", f"SELECT o.id, {PARTY_COLS} {PARTY}")
check("lookup_join", """SELECT l.id, l.product_id, l.quantity, cast(coalesce(p.stock >= l.quantity, false) AS int) AS in_stock
        FROM sh_lines l LEFT JOIN sh_products p ON p.id = l.product_id""")


def _items(fields: str) -> str:
    return f"""(SELECT parent_id, string_agg({fields}, '|' ORDER BY id) AS items FROM sh_lines GROUP BY 1)"""


check("nest_children", f"""SELECT o.id, coalesce(i.items, '') AS items FROM sh_orders o
        LEFT JOIN {_items("concat_ws(':', id, quantity)")} i ON i.parent_id = o.id""")


def _free(kind: str, table: str) -> str:
    return f"""SELECT '{kind}' AS kind, a.id, cast(NOT EXISTS (SELECT 1 FROM {table} b
        WHERE lower(trim(b.name)) = lower(trim(a.name)) AND b.id <> a.id) AS int) AS available FROM {table} a"""


check("key_conflicts", " UNION ALL ".join(
    [_free("category", "sh_categories"), _free("subcategory", "sh_subcategories"), _free("product", "sh_products")]))
check("cross_table_conflicts", """SELECT a.id, a.phone, cast(NOT EXISTS (SELECT 1 FROM sh_users b
        WHERE b.phone = a.phone AND b.id <> a.id) AND NOT EXISTS (SELECT 1 FROM sh_customers c
        WHERE c.whatsapp_number = a.phone) AS int) AS available FROM sh_users a""")
check("duplicate_names", """SELECT lower(trim(name)) AS key, count(*) AS uses, min(id) AS first_id FROM sh_products
        GROUP BY 1 HAVING count(*) > 1""")
check("update_join", """SELECT l.id, l.parent_id AS order_id, coalesce(l.product_code, p.product_code) AS product_code
        FROM sh_lines l LEFT JOIN sh_products p ON p.id = l.product_id""")
check("referential_checks", """
        SELECT s.id, s.category_id, CASE WHEN c.id IS NULL THEN 'orphan' ELSE 'cascade' END AS kind
        FROM sh_subcategories s LEFT JOIN (SELECT * FROM sh_categories WHERE is_active = 1) c ON c.id = s.category_id
        UNION ALL SELECT p.id, c.id, 'set_null' FROM sh_products p
        LEFT JOIN (SELECT * FROM sh_categories WHERE is_active = 1) c ON c.id = p.category_id""")
check("wrong_parent", """SELECT p.id, p.category_id % 25 + 1 AS category_id, s.category_id AS owner
        FROM sh_products p JOIN sh_subcategories s ON s.id = p.subcategory_id
        WHERE s.category_id <> p.category_id % 25 + 1""")
WISHES = """wishes AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'customer' ELSE 'staff' END AS owner_type,
        user_id AS owner_id, k AS product_id, ts AS created_at FROM bk_events WHERE event_type = 'view')"""
check("wishlist_join", f"""SELECT w.owner_type, w.owner_id, w.product_id, {stamp('w.created_at', 'created_at')}, p.name,
        {cents('p.sale_price', 'sale_price')}, p.category_name, p.category_slug
        FROM (SELECT owner_type, owner_id, product_id, max(created_at) AS created_at FROM wishes GROUP BY 1, 2, 3) w
        JOIN sh_named p ON p.id = w.product_id""", extra=WISHES)
check("first_source_wins", """SELECT e.event_id, '94' || lpad(cast(e.user_id AS varchar), 9, '0') AS login,
        CASE WHEN u.id IS NOT NULL THEN 'staff' WHEN c.id IS NOT NULL THEN 'customer' END AS owner_type,
        coalesce(u.id, c.id) AS owner_id, coalesce(u.name, c.name) AS owner_name
        FROM bk_events e
        LEFT JOIN sh_users u ON u.phone = '94' || lpad(cast(e.user_id AS varchar), 9, '0')
        LEFT JOIN sh_customers c ON c.whatsapp_number = '94' || lpad(cast(e.user_id AS varchar), 9, '0')""")

# --- aggregations -----------------------------------------------------------

check("global_sum", f"SELECT {cents('coalesce(sum(amount), 0)', 'paid')} FROM bk_payments")
check("filtered_count", """SELECT count(*) FILTER (status = 'completed') AS completed,
        count(*) FILTER (status = 'voided') AS voided, count(*) FILTER (status = 'returned') AS returned FROM bk_sales""")
check("status_breakdown", "SELECT status, count(*) AS count FROM sh_orders GROUP BY 1")
check("sum_by_day", f"SELECT {day('created_at')}, {cents('sum(total_amount)', 'revenue')} FROM ({EARNED}) GROUP BY 1")
check("sum_of_product", f"""SELECT {cents('sum(l.quantity * p.purchase_price)', 'cost')}
        FROM sh_lines l JOIN sh_products p ON p.id = l.product_id""")
check("conditional_agg", "SELECT staff_id, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}_count, "
    + cents(f"coalesce(sum(total_amount) FILTER (status = '{s}'), 0)", f"{s}_total")
    for s in ("completed", "voided", "returned")) + " FROM bk_sales GROUP BY 1")
check("sum_by_day_staff", f"""SELECT {day('s.created_at')}, s.staff_id, u.name AS staff_name, count(*) AS n,
        {cents('sum(s.total_amount)', 'total')} FROM sh_sales s JOIN sh_users u ON u.id = s.staff_id
        WHERE s.status = 'completed' GROUP BY 1, 2, 3""")
check("staff_day_totals", f"""SELECT {day('created_at')}, staff_id, count(*) AS transaction_count,
        {cents('sum(total_amount)', 'total_sales')}, {cents('sum(discount_amount)', 'total_discount')}
        FROM bk_sales WHERE status = 'completed' AND {RANGE} GROUP BY 1, 2""")
check("max_numeric_code", """SELECT max(cast(product_code AS bigint)) AS max_code FROM sh_products
        WHERE regexp_full_match(product_code, '[0-9]+')""")
check("all_rows_satisfy", """SELECT parent_id AS order_id, cast(bool_and(returned_quantity >= quantity) AS int) AS all_back
        FROM sh_lines GROUP BY 1""")
check("distinct_values", """SELECT cast(cast(created_at AS date) AS varchar) AS value FROM sh_sales
        UNION SELECT name FROM sh_products""")


def _full(*cols: str) -> str:
    return "(" + " AND ".join(f"coalesce(trim({c}), '') <> ''" for c in cols) + ")"


SECTIONS = {"contact": _full("email", "phone"), "shop": _full("shop_name", "city"), "status": _full("status")}
DONE = " + ".join(f"cast({s} AS int)" for s in SECTIONS.values())
check("completeness", "SELECT id, " + ", ".join(f"cast({s} AS int) AS {n}_complete" for n, s in SECTIONS.items())
      + f", {DONE} AS completed_count, 3 AS total_count, cast(round(100.0 * ({DONE}) / 3) AS int) AS percent FROM sh_users")
check("column_fill", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (trim(cast({c} AS varchar)) <> '') AS filled, count(*) AS total FROM sh_customers"
    for c in ("id", "name", "whatsapp_number", "email")))
check("existence_count", """SELECT o.id, count(l.parent_id) AS children FROM sh_orders o
        LEFT JOIN sh_lines l ON l.parent_id = o.id GROUP BY 1""")
check("residual_to_largest", """SELECT sale_id, method,
          cut + CASE WHEN live AND row_number() OVER (PARTITION BY sale_id ORDER BY cut DESC, method) = 1
                     THEN new - cast(sum(cut) OVER (PARTITION BY sale_id) AS bigint) ELSE 0 END AS amount
        FROM (SELECT p.sale_id, p.method, t.old > 0 AND t.new > 0 AS live, t.new,
                     cast(CASE WHEN t.old > 0 THEN (cast(p.paid AS hugeint) * t.new * 2 + t.old) // (t.old * 2) ELSE 0 END
                          AS bigint) AS cut
              FROM (SELECT sale_id, method, cast(round(sum(amount) * 100) AS bigint) AS paid FROM bk_payments GROUP BY 1, 2) p
              JOIN (SELECT id, cast(round(total_amount * 100) AS bigint) AS old,
                           cast(round(subtotal * 100) AS bigint) AS new FROM bk_sales) t ON t.id = p.sale_id)""")

# --- lists ------------------------------------------------------------------

check("sales_list", f"""SELECT s.id, s.staff_id, u.name AS staff_name, s.customer_id, c.name AS customer_name,
        {cents('s.total_amount', 'total_amount')}, s.status, {stamp('s.created_at', 'created_at')}
        FROM sh_sales s JOIN sh_users u ON u.id = s.staff_id LEFT JOIN sh_customers c ON c.id = s.customer_id
        ORDER BY s.created_at DESC, s.id DESC LIMIT 200""")
check("sales_list_filtered", f"""SELECT s.id, s.staff_id, u.name AS staff_name, c.name AS customer_name,
        {cents('s.total_amount', 'total_amount')}, {stamp('s.created_at', 'created_at')}
        FROM bk_sales s JOIN sh_users u ON u.id = s.staff_id LEFT JOIN sh_customers c ON c.id = s.customer_id
        WHERE s.staff_id = 3 AND s.created_at >= timestamp '2024-01-10'
        ORDER BY s.created_at DESC, s.id DESC LIMIT 200""")
check("sale_detail", f"""SELECT s.id, u.name AS staff_name, c.name AS customer_name,
        {cents('s.total_amount', 'total_amount')}, s.status, coalesce(i.items, '') AS items
        FROM sh_sales s JOIN sh_users u ON u.id = s.staff_id LEFT JOIN sh_customers c ON c.id = s.customer_id
        LEFT JOIN {_items("concat_ws(':', id, product_id, quantity, returned_quantity)")} i ON i.parent_id = s.id""")
check("orders_admin_list", f"""SELECT o.id, {cents('o.total_amount', 'total_amount')}, o.status,
        {stamp('o.created_at', 'created_at')}, {PARTY_COLS}, coalesce(i.items, '') AS items {PARTY}
        LEFT JOIN {_items("concat_ws(':', id, product_code, price, quantity)")} i ON i.parent_id = o.id""")
check("my_orders", f"""SELECT CASE WHEN o.customer_id IS NOT NULL THEN 'customer' ELSE 'staff' END AS party_type,
        coalesce(o.customer_id, o.user_id) AS party_id, o.id, o.status, {cents('o.total_amount', 'total_amount')},
        coalesce(i.items, '') AS items FROM sh_orders o
        LEFT JOIN {_items("concat_ws(':', id, product_name, quantity)")} i ON i.parent_id = o.id""")
check("product_list", f"SELECT {_without({'product_code', 'purchase_price'})}, {NAMES4} FROM sh_named WHERE is_active = 1 AND stock > 0")
check("product_list_filtered", f"""SELECT * FROM (SELECT {_without({'product_code'} | RETAIL3)}, {NAMES4} FROM sh_named
        WHERE is_active = 1 AND category_slug = 'brand-4' AND {_search('%e%')}
        ORDER BY sh_named.created_at DESC, id LIMIT 25 OFFSET 5)""")
check("wholesale_list", f"""SELECT id, slug, name, product_code, {cents('purchase_price', 'purchase_price')}, stock,
        {NAMES4} FROM sh_named WHERE is_active = 1 AND {_search('%economy%')}""")


def _users(status: str) -> str:
    return f"""SELECT u.id, u.name, u.email, u.phone, u.shop_name, u.city, r.name AS role, u.status, u.is_active,
        {stamp('u.created_at', 'created_at')} FROM sh_users u JOIN sh_roles r ON r.id = u.role_id
        WHERE u.status = '{status}' AND r.name IN ('Admin','Seller','Staff')
          AND u.email != 'anonymous-seller@internal.local'"""


check("users_list", _users("approved"))
check("users_pending", _users("pending"))
check("subcategory_list", f"""SELECT s.id, s.category_id, s.name, s.slug, s.is_active, {stamp('s.created_at', 'created_at')},
        c.name AS category_name, c.slug AS category_slug
        FROM sh_subcategories s JOIN sh_categories c ON c.id = s.category_id WHERE s.is_active = 1""")
check("holds_list", f"""SELECT e.event_id AS id, e.staff_id, c.name AS customer_name, {stamp('e.ts', 'created_at')},
        e.user_id || ':' || e.k || '|' || e.event_id || ':1' AS items
        FROM bk_events e LEFT JOIN sh_customers c ON c.id = e.user_id WHERE e.event_type = 'view'""")
check("json_items", """SELECT event_id AS hold_id, 1 AS line_no, user_id AS product_id, k AS quantity FROM bk_events
        WHERE event_type = 'view'
        UNION ALL SELECT event_id, 2, event_id, 1 FROM bk_events WHERE event_type = 'view'""")

# --- sorts, limits, sets ----------------------------------------------------

check("multi_key_order", """SELECT id, name, total_sold, row_number() OVER (ORDER BY total_sold DESC, name) AS rank
        FROM (SELECT g.id, g.name, cast(coalesce(sum(ci.quantity), 0) AS bigint) AS total_sold
              FROM sh_categories g LEFT JOIN sh_products p ON p.category_id = g.id
              LEFT JOIN sh_combined ci ON ci.product_id = p.id WHERE g.is_active = 1 GROUP BY 1, 2)""")
check("page", f"""SELECT id, {stamp('created_at', 'created_at')} FROM (
        SELECT id, created_at FROM sh_products ORDER BY created_at DESC, id LIMIT 40 OFFSET 120)""")
check("top_k", f"SELECT id, {cents('total_amount', 'total_amount')} FROM (SELECT * FROM sh_orders ORDER BY total_amount DESC, id LIMIT 25)")
check("priority_order", """SELECT role_id, id, name, status, priority FROM (
        SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY priority, id) AS rn FROM (
          SELECT *, CASE WHEN status = 'approved' THEN 0 ELSE 1 END AS priority FROM sh_users)) WHERE rn = 1""")
check("arg_max", f"""SELECT sale_id, id, {cents('amount', 'amount')} FROM (
        SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY amount DESC, id) AS rn FROM bk_payments) WHERE rn = 1""")
check("union_all_channels", f"SELECT {stamp('created_at', 'created_at')}, {cents('total_amount', 'total_amount')} FROM ({EARNED})")
check("union_distinct", """SELECT 'phone' AS kind, whatsapp_number AS key FROM sh_customers
        UNION SELECT 'phone', phone FROM sh_users
        UNION SELECT 'email', email FROM sh_customers WHERE email IS NOT NULL UNION SELECT 'email', email FROM sh_users""")
check("set_difference", """SELECT id, name FROM sh_customers WHERE id NOT IN (
        SELECT customer_id FROM sh_orders WHERE customer_id IS NOT NULL)""")
check("permutation_check", """SELECT user_id || '-' || cast(day AS varchar) AS list,
        cast(count(*) = 5 AND count(DISTINCT event_type) = 5 AS int) AS valid FROM bk_events GROUP BY 1""")

# --- windows ----------------------------------------------------------------

check("line_numbers", """SELECT parent_id AS order_id, id,
        row_number() OVER (PARTITION BY parent_id ORDER BY line_no, id) AS number FROM sh_lines""")
check("latest_per_key", f"""SELECT user_id, event_type, {stamp('ts', 'ts')}, event_id, {cents('v', 'v')} FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
        FROM bk_events) WHERE rn = 1""")
MOVES = """moves AS (
        SELECT product_id, h.created_at, u.kind, u.step, l.id AS line_id, u.delta
        FROM sh_lines l JOIN sh_orders h ON h.id = l.parent_id AND h.status IN ('successful', 'return'),
             LATERAL (VALUES ('approval', 1, -l.quantity),
                ('order_return', 2, CASE WHEN h.status = 'return' THEN l.quantity ELSE l.returned_quantity END)) u(kind, step, delta)
        WHERE u.delta <> 0
        UNION ALL
        SELECT product_id, h.created_at, u.kind, u.step, l.id, u.delta
        FROM sh_lines l JOIN sh_sales h ON h.id = l.parent_id,
             LATERAL (VALUES ('sale', 3, -l.quantity),
                ('sale_return', 4, CASE WHEN h.status = 'returned' THEN l.quantity ELSE l.returned_quantity END),
                ('void', 5, CASE WHEN h.status = 'voided' THEN greatest(0, l.quantity - l.returned_quantity) ELSE 0 END)) u(kind, step, delta)
        WHERE u.delta <> 0)"""
check("stock_ledger", f"""SELECT m.product_id, {stamp('m.created_at', 'created_at')}, m.kind, m.line_id,
        cast(m.delta AS bigint) AS delta, cast(p.stock + sum(m.delta) OVER (PARTITION BY m.product_id
          ORDER BY m.created_at, m.step, m.line_id ROWS UNBOUNDED PRECEDING) AS bigint) AS balance
        FROM moves m JOIN sh_products p ON p.id = m.product_id""", extra=MOVES)
check("share_of_total", """SELECT id, parent_id AS sale_id,
        cast((value * 10000) // cast(sum(value) OVER (PARTITION BY parent_id) AS bigint) AS bigint) AS share
        FROM (SELECT *, cast(round(price * 100) AS bigint) * quantity AS value FROM sh_lines)""")


def fold(requests: str, need: str = "q", room: str = "room") -> str:
    """Requests with their key, rank and starting room, decided one after the other."""
    return f"""req AS MATERIALIZED ({requests}),
    fold AS (
        SELECT key, rn, ref, {need} <= {room} AND {need} > 0 AS ok,
               {room} - CASE WHEN {need} <= {room} AND {need} > 0 THEN {need} ELSE 0 END AS room FROM req WHERE rn = 1
        UNION ALL
        SELECT r.key, r.rn, r.ref, r.{need} <= f.room AND r.{need} > 0,
               f.room - CASE WHEN r.{need} <= f.room AND r.{need} > 0 THEN r.{need} ELSE 0 END
        FROM fold f JOIN req r ON r.key = f.key AND r.rn = f.rn + 1)"""


check("cooldown", """SELECT user_id, event_type, second, event_id FROM walk WHERE ok""", recursive=True,
      extra="""req AS MATERIALIZED (SELECT user_id, event_type, event_id, cast(floor(epoch(ts)) AS bigint) AS second,
            row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM bk_events),
        walk AS (SELECT user_id, event_type, event_id, second, rn, true AS ok, second AS last FROM req WHERE rn = 1
            UNION ALL
            SELECT r.user_id, r.event_type, r.event_id, r.second, r.rn, r.second - w.last >= 86400,
                   CASE WHEN r.second - w.last >= 86400 THEN r.second ELSE w.last END
            FROM walk w JOIN req r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.rn = w.rn + 1)""")

# --- scalars ----------------------------------------------------------------

check("discount_price", f"SELECT id, {cents('discount_price', 'discount_price')} FROM sh_products")


def _implied(price: str, cut: str) -> str:
    p, d = f"cast(round({price} * 100) AS bigint)", f"cast(round({cut} * 100) AS bigint)"
    return f"CASE WHEN {price} > 0 THEN cast((abs({p} - {d}) * 20000 + {p}) // (2 * {p}) * sign({p} - {d}) AS bigint) ELSE 0 END"


check("implied_discount_pct", f"""SELECT id, {_implied('sale_price', 'discount_price')} AS percent,
        {_implied('sale_price', 'purchase_price')} AS margin FROM sh_products""")
check("scalar_basics", f"""SELECT id, coalesce(shipping_name, '-') AS receiver,
        CASE WHEN customer_id IS NULL THEN 'staff' ELSE 'customer' END AS party, {day('created_at')},
        try_cast(shipping_name AS bigint) AS as_number,
        date_diff('day', cast(created_at AS date), date '2001-08-01') AS age_days, status AS status_key FROM sh_orders""")
SLUG = "trim(regexp_replace(trim(lower({0})), '[^a-z0-9]+', '-', 'g'), '-')"
check("slugify", f"SELECT page_id, {SLUG.format('url')} AS slug FROM pages")


def _param(name: str) -> str:
    pattern = name + "=([^&\"''\\s]+)"
    return f"array_to_string(list_transform(regexp_extract_all(url, '{pattern}', 1), lambda v: url_decode(v)), '|') AS {name}"


check("extract_url_params", f"SELECT page_id, {_param('page')}, {_param('ref')}, {_param('utm_source')} FROM pages")
check("font_families", """SELECT page_id, 0 AS pos, replace(host, '.', ' ') AS name,
          replace(host, '.', '+') || ':wght@400' AS family_param
        FROM (SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host FROM pages)
        UNION ALL SELECT page_id, 1, 'Noto Sans Mono', 'Noto+Sans Mono:ital' FROM pages""")
check("page_links", """SELECT page_id, cast(pos - 1 AS int) AS pos, CASE WHEN trim(href) = '' THEN ''
          WHEN regexp_matches(href, '^(?i)https?://') THEN href
          WHEN starts_with(href, '/') THEN 'https://shop.test' || href ELSE 'https://shop.test/' || href END AS link
        FROM (SELECT page_id, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS pos
              FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))""")
check("resolve_url", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url
          WHEN path = '' THEN '' WHEN starts_with(path, '/') THEN 'https://shop.test' || path
          ELSE 'https://shop.test/' || path END AS link
        FROM (SELECT *, regexp_extract(url, '//[^/]+/(.*)$', 1) AS path FROM pages)""")
check("folder_id", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a_' || page_id ELSE 'id-' || page_id END AS folder
        FROM pages""")
RS = "'Rs. ' || format('{{:,}}', cast(round({0}) AS bigint)) || '/='"
check("format_money", f"SELECT id, {RS.format('total_amount')} AS total FROM sh_orders")
check("format_datetime", "SELECT event_id, strftime(ts, '%d %b %Y, %I:%M %p') AS shown FROM bk_events")
check("timestamp_suffix", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM bk_events")
check("is_filled", "SELECT id, cast(coalesce(trim(email), '') <> '' AS int) AS filled FROM sh_customers")
check("scalar_math", """SELECT id, greatest(0, quantity - 25) AS over, least(quantity, 10) AS capped,
        cast((cast(round(price * 100) AS bigint) + 5999) // 6000 AS bigint) AS minutes, cast(round(price) AS bigint) AS whole,
        abs(quantity - 25) AS distance FROM sh_lines""")
check("net_qty", "SELECT id, greatest(0, quantity - returned_quantity) AS net FROM sh_lines")
check("round2", f"SELECT id, {cents('round(price * 0.125, 2)', 'eighth')} FROM sh_lines")
check("stable_unit_hash", f"""SELECT id, hash, cast(hash * 100 // 4294967296 AS bigint) AS percentile
        FROM (SELECT id, {fnv("'z:' || slug")} AS hash FROM sh_products)""")
check("bill_ratio", """SELECT id, CASE WHEN s > 0 THEN t * 10000 // s ELSE 0 END AS ratio FROM (
        SELECT id, cast(round(total_amount * 100) AS bigint) AS t, cast(round(subtotal * 100) AS bigint) AS s FROM sh_sales)""")
check("item_label", "SELECT id, coalesce('#' || product_code, product_name) AS label FROM sh_lines")
check("weighted_pick", """SELECT c.id, w.product_id FROM
        (SELECT id, id * 7919 % (SELECT cast(sum(stock % 8 + 1) AS bigint) FROM sh_products) AS slot FROM sh_customers) c
        JOIN (SELECT id AS product_id, cast(sum(stock % 8 + 1) OVER (ORDER BY id) AS bigint) AS upto,
                     stock % 8 + 1 AS w FROM sh_products) w ON c.slot < w.upto AND c.slot >= w.upto - w.w""")
check("weighted_pick_decimal", """SELECT c.id, w.product_id FROM
        (SELECT id, id * 7919777 % (SELECT cast(sum(sale_price) * 100 AS bigint) FROM sh_products) AS at FROM sh_customers) c
        JOIN (SELECT id AS product_id, cast(sum(sale_price) OVER (ORDER BY id) * 100 AS bigint) AS upto,
                     cast(sale_price * 100 AS bigint) AS w FROM sh_products) w ON c.at < w.upto AND c.at >= w.upto - w.w""")


def _bill(title: str, who: str, extra_head: str, note: str, total: str, people: str, where: str) -> str:
    return f"""SELECT o.id AS order_id, concat_ws(chr(10), '*Shop - {title}*', '', '*Order ID:* #' || o.id,
          '*{who}:* ' || p.sender_name, '*Contact:* ' || p.sender_phone, {extra_head}
          '*Date:* ' || strftime(o.created_at, '%d %b %Y, %I:%M %p'), repeat('-', 24), l.lines, repeat('-', 24),
          '*{total}: ' || {RS.format('o.total_amount')} || '*', '',
          'Our staff will contact you soon. Thanks for your patience.') AS message
        FROM {where} o JOIN {people}
        LEFT JOIN (SELECT parent_id, string_agg(n || '. ' || coalesce('#' || product_code, product_name) || chr(10) || '    '
                || quantity || ' x ' || {RS.format('price')} || '{note} = ' || {RS.format('price * quantity')},
                chr(10) ORDER BY n) AS lines
              FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY line_no, id) AS n FROM sh_lines)
              GROUP BY 1) l ON l.parent_id = o.id"""


check("order_bill_text", _bill(
    "Order Request", "Customer", "", "", "Total",
    "(SELECT id, name AS sender_name, CASE WHEN id % 2 = 0 THEN whatsapp_number END AS sender_phone FROM sh_customers) p"
    " ON p.id = o.customer_id", "sh_orders"))
check("seller_bill_text", _bill(
    "Seller Order", "Seller", "'*Shop:* ' || p.shop_name, '*City:* ' || p.city,", " (cost)", "Total (Cost Price)",
    "(SELECT id, name AS sender_name, phone AS sender_phone, shop_name, CASE WHEN id % 2 = 0 THEN city END AS city"
    " FROM sh_users) p ON p.id = o.user_id", "sh_seller_orders"))
check("rename_status", """SELECT CASE o_orderstatus WHEN 'F' THEN 'successful' ELSE 'pending' END AS status, count(*) AS n
        FROM orders GROUP BY 1""")

# --- state changes ----------------------------------------------------------

check("price_lines", f"""SELECT l.id, l.parent_id AS order_id, p.name AS product_name, p.product_code,
        {cents('CASE WHEN s.id IS NOT NULL THEN p.purchase_price ELSE p.discount_price END', 'price')}, l.quantity,
        {cents('(CASE WHEN s.id IS NOT NULL THEN p.purchase_price ELSE p.discount_price END) * l.quantity', 'line_total')}
        FROM sh_lines l JOIN sh_orders o ON o.id = l.parent_id JOIN sh_products p ON p.id = l.product_id
        LEFT JOIN sh_seller_orders s ON s.id = o.id""")
check("bill_totals", f"""SELECT sale_id, status, {cents('subtotal', 'subtotal')}, {cents('discount_amount', 'discount_amount')},
        {cents('after', 'after_discount')}, {cents('round(tax, 2)', 'tax_amount')}, {cents('round(svc, 2)', 'service_amount')},
        {cents('round(total, 2)', 'total_amount')}, {cents('round(paid, 2)', 'amount_paid')},
        {cents('round(total - paid, 2)', 'balance_due')}
        FROM (SELECT *, CASE WHEN ask IS NULL OR ask < 0 THEN total ELSE least(ask, total) END AS paid
        FROM (SELECT *, after + tax + svc AS total
        FROM (SELECT *, after * (sale_id % 4 * 2.5) * 0.01 AS tax, after * cast(sale_id % 3 * 5 AS decimal(5,2)) * 0.01 AS svc
        FROM (SELECT *, greatest(0, subtotal - discount_amount) AS after
        FROM (SELECT s.id AS sale_id, s.status, c.subtotal,
                     CASE WHEN s.id % 7 = 0 THEN c.subtotal + 1 ELSE least(s.discount_amount, c.subtotal) END AS discount_amount,
                     CASE s.id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE s.balance_due END AS ask
              FROM sh_sales s JOIN (SELECT l.parent_id, sum(l.quantity * CASE WHEN p.discount_percent > 0
                  THEN p.discount_price ELSE p.sale_price END) AS subtotal
                FROM sh_lines l JOIN sh_products p ON p.id = l.product_id GROUP BY 1) c ON c.parent_id = s.id)))))""")
STOCK_REQ = """SELECT l.product_id AS key, l.id AS ref, l.parent_id, l.quantity AS q, p.stock AS room,
        row_number() OVER (PARTITION BY l.product_id ORDER BY o.created_at, o.id, l.id) AS rn
        FROM sh_lines l JOIN sh_orders o ON o.id = l.parent_id JOIN sh_products p ON p.id = l.product_id"""
check("stock_check", """SELECT r.ref AS id, r.parent_id AS order_id, r.key AS product_id, r.q AS quantity,
        cast(f.ok AS int) AS admitted FROM req r JOIN fold f ON f.key = r.key AND f.rn = r.rn""",
      extra=fold(STOCK_REQ), recursive=True)


def serial(lines: str) -> str:
    """Requests of several lines (ref, moment, key, need, delta), one after the other, each as a whole: their ref and ``ok``.

    The stock of all products goes along as one list.
    """
    return f"""places AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS place, stock FROM sh_products),
        req AS MATERIALIZED (
          SELECT ref, row_number() OVER (ORDER BY any_value(moment), ref) AS rn,
                 list({{'p': cast(place AS int), 'n': need, 'd': delta}}) AS ls
          FROM (SELECT ref, any_value(moment) AS moment, place, max(need) AS need, cast(sum(delta) AS int) AS delta
                FROM ({lines}) JOIN places ON id = key GROUP BY ref, place) GROUP BY ref),
        serial AS (
          SELECT cast(0 AS bigint) AS rn, cast(NULL AS bigint) AS ref, true AS ok,
                 (SELECT list(cast(stock AS int) ORDER BY place) FROM places) AS held
          UNION ALL
          SELECT rn, ref, ok, CASE WHEN ok THEN list_reduce(
                     list_prepend({{'s': held, 'p': 0, 'd': 0}}, list_transform(ls, lambda l: {{'s': []::int[], 'p': l.p, 'd': l.d}})),
                     lambda a, l: {{'s': a.s[1:l.p - 1] || [a.s[l.p] + l.d] || a.s[l.p + 1:], 'p': 0, 'd': 0}}).s ELSE held END
          FROM (SELECT r.rn, r.ref, len(list_filter(r.ls, lambda l: l.n > w.held[l.p])) = 0 AS ok, r.ls, w.held
                FROM serial w JOIN req r ON r.rn = w.rn + 1))"""


check("stock_check_carts", """SELECT parent_id AS order_id, count(*) AS lines, cast(any_value(ok) AS int) AS accepted
        FROM sh_lines JOIN serial ON ref = parent_id GROUP BY 1""", recursive=True, extra=serial(
    "SELECT l.parent_id AS ref, o.created_at AS moment, l.product_id AS key, l.quantity AS need, -l.quantity AS delta"
    " FROM sh_lines l JOIN sh_orders o ON o.id = l.parent_id"))
TRANSITION = """asked AS (SELECT id AS order_id, status AS from_status, total_amount,
          created_at + to_days(cast(id % 7 AS int)) AS requested_at,
          ['pending','successful','return','cancelled','shipped'][cast(id % 5 AS int) + 1] AS to_status FROM sh_orders),
        """ + serial("""SELECT * FROM (
              SELECT a.order_id AS ref, a.requested_at AS moment, l.product_id AS key,
                     CASE WHEN a.to_status = 'successful' THEN l.quantity END AS need,
                     CASE WHEN a.to_status = 'successful' THEN -l.quantity
                          ELSE greatest(0, l.quantity - l.returned_quantity) END AS delta
              FROM asked a JOIN sh_lines l ON l.parent_id = a.order_id
              WHERE a.to_status <> 'shipped' AND (a.to_status = 'successful') <> (a.from_status = 'successful'))""") + """,
        judged AS (SELECT a.*, CASE WHEN to_status = 'shipped' THEN 'invalid status'
            WHEN to_status = 'successful' AND from_status <> 'successful' AND NOT coalesce(s.ok, true) THEN 'not enough stock'
            ELSE 'ok' END AS outcome FROM asked a LEFT JOIN serial s ON s.ref = a.order_id)"""
check("order_transition", f"""SELECT order_id, to_status, from_status, outcome,
        CASE WHEN outcome = 'ok' THEN to_status ELSE from_status END AS status,
        {cents("CASE WHEN outcome = 'ok' AND from_status = 'successful' AND to_status = 'return' THEN 0 ELSE total_amount END", 'total_amount')}
        FROM judged""", extra=TRANSITION, recursive=True)
check("order_transition_lines", """SELECT l.id, l.parent_id AS order_id,
        cast(CASE WHEN j.outcome = 'ok' AND j.from_status = 'successful' AND j.to_status = 'return' THEN l.quantity
             ELSE l.returned_quantity END AS int) AS returned_quantity
        FROM sh_lines l LEFT JOIN judged j ON j.order_id = l.parent_id""", extra=TRANSITION, recursive=True)
check("order_transition_moves", """SELECT * FROM (SELECT j.order_id, l.id AS line_id, l.product_id,
          cast(CASE WHEN j.to_status = 'successful' THEN -l.quantity
               ELSE greatest(0, l.quantity - l.returned_quantity) END AS bigint) AS delta
        FROM judged j JOIN sh_lines l ON l.parent_id = j.order_id
        WHERE j.outcome = 'ok' AND (j.to_status = 'successful') <> (j.from_status = 'successful')) WHERE delta <> 0""",
      extra=TRANSITION, recursive=True)
check("resold_after_return", f"""SELECT o.id, {cents('o.total_amount', 'total_amount')} FROM sh_orders o
        JOIN (SELECT parent_id FROM sh_lines GROUP BY 1 HAVING bool_and(returned_quantity >= quantity)) l ON l.parent_id = o.id
        WHERE o.status = 'successful'""")


def _returns(header: str, open_status: str, returned: str) -> str:
    return f"""asked AS (SELECT id, parent_id, product_id, price, quantity, {returned} AS returned_quantity,
            CASE WHEN product_id % 97 = 0 THEN quantity + 1 ELSE quantity // 3 END AS back FROM sh_lines),
        verdict AS (SELECT a.parent_id, CASE WHEN any_value(h.id) IS NULL THEN 'not found'
              WHEN any_value(h.status) <> '{open_status}' THEN 'not open for returns'
              WHEN bool_or(a.back > 0 AND a.back > a.quantity - a.returned_quantity) THEN 'more than remaining' END AS reason
            FROM asked a LEFT JOIN {header} h ON h.id = a.parent_id GROUP BY 1),
        figures AS (SELECT a.parent_id, sum(price * back) AS gone,
              sum(price * (quantity - returned_quantity - back)) AS remaining,
              bool_and(returned_quantity + back >= quantity) AS all_back
            FROM asked a JOIN verdict v ON v.parent_id = a.parent_id AND v.reason IS NULL GROUP BY 1)"""


check("order_return", f"""SELECT parent_id AS order_id, {cents('remaining', 'total_amount')},
        CASE WHEN all_back THEN 'return' ELSE 'successful' END AS status FROM figures""",
      extra=_returns("sh_orders", "successful", "returned_quantity"))
check("order_return_refused", "SELECT parent_id AS order_id, reason FROM verdict WHERE reason IS NOT NULL",
      extra=_returns("sh_orders", "successful", "returned_quantity"))
RETURNED = """SELECT a.id, a.parent_id AS {0}, cast(returned_quantity + back AS bigint) AS returned_quantity,
        cast(back AS bigint) AS came_back FROM asked a JOIN verdict v ON v.parent_id = a.parent_id AND v.reason IS NULL"""
check("order_return_lines", RETURNED.format("order_id"), extra=_returns("sh_orders", "successful", "returned_quantity"))
check("sale_return_lines", RETURNED.format("sale_id") + " JOIN sh_sales s ON s.id = a.parent_id", extra=_returns("sh_sales", "completed", "0"))
check("sale_return_refused", "SELECT v.parent_id AS sale_id, reason FROM verdict v WHERE reason IS NOT NULL",
      extra=_returns("sh_sales", "completed", "0"))
check("sale_return", """SELECT b.id AS sale_id, sub - gone AS subtotal, total AS total_amount, total - paid AS balance_due, status
        FROM (SELECT b.id, b.sub, b.paid, cast(round(f.gone * 100) AS bigint) AS gone,
                CASE WHEN f.all_back THEN 'returned' ELSE 'completed' END AS status,
                cast((cast(b.paid AS hugeint) * (b.sub - cast(round(f.gone * 100) AS bigint)) * 2 + b.sub) // (2 * b.sub) AS bigint) AS total
              FROM figures f JOIN bills b ON b.id = f.parent_id) b""",
      extra=_returns("sh_sales", "completed", "0") + """,
        bills AS (SELECT id, cast(round(sub * 100) AS bigint) AS sub,
            cast(round(round(greatest(0, sub - disc) + greatest(0, sub - disc) * (id % 4 * 2.5) * 0.01, 2) * 100) AS bigint) AS paid
          FROM (SELECT s.id, c.sub, round(c.sub * cast(s.id % 5 AS int) * 0.01, 2) AS disc FROM sh_sales s
                JOIN (SELECT parent_id, cast(sum(price * quantity) AS decimal(20,2)) AS sub FROM sh_lines GROUP BY 1) c ON c.parent_id = s.id))""")
check("stock_movements", f"""SELECT product_id, {stamp('created_at', 'created_at')}, line_id, kind, cast(delta AS bigint) AS delta
        FROM moves""", extra=MOVES)
check("stock_balance", """SELECT p.id AS product_id, cast(p.stock AS bigint) AS opening, cast(coalesce(m.d, 0) AS bigint) AS moved,
        cast(p.stock + coalesce(m.d, 0) AS bigint) AS balance FROM sh_products p
        LEFT JOIN (SELECT product_id, sum(delta) AS d FROM moves GROUP BY 1) m ON m.product_id = p.id""", extra=MOVES)
check("void_sales", """SELECT r.id + 1 AS sale_id, CASE WHEN s.id IS NULL THEN 'not found'
        WHEN s.status = 'voided' THEN 'already voided' WHEN s.status = 'returned' THEN 'already returned' ELSE 'ok' END AS outcome
        FROM sh_sales r LEFT JOIN sh_sales s ON s.id = r.id + 1""")
check("void_restock", """SELECT l.product_id, cast(sum(l.quantity - l.returned_quantity) AS bigint) AS restored
        FROM sh_lines l JOIN sh_sales s ON s.id = l.parent_id
        WHERE s.status = 'completed' AND l.quantity > l.returned_quantity GROUP BY 1""")
PAY_REQ = """SELECT a.*, CASE WHEN a.amount <= 0 THEN 'invalid amount' WHEN a.method = 'barter' THEN 'invalid method'
            WHEN h.shift_id IS NULL THEN 'no open shift' WHEN s.id IS NULL THEN 'sale not found'
            WHEN s.status <> 'completed' THEN 'sale not completed' END AS fault,
        CASE WHEN fault IS NULL THEN amount ELSE 0 END AS q, h.shift_id,
        CASE WHEN s.status = 'completed' THEN cast(round(s.balance_due * 100) AS bigint) ELSE 0 END AS room,
        row_number() OVER (PARTITION BY a.key ORDER BY a.created_at, a.ref) AS rn
        FROM (SELECT CASE WHEN id % 13 = 0 THEN -id ELSE sale_id END AS key, id AS ref,
                     CASE WHEN id % 17 = 0 THEN 0 ELSE cast(round(amount * 5 * 100) AS bigint) END AS amount,
                     CASE WHEN id % 11 = 0 THEN 'barter' ELSE method END AS method,
                     staff_id + CASE WHEN id % 3 = 0 THEN 1000 ELSE 0 END AS staff_id, created_at FROM bk_late) a
        LEFT JOIN bk_sales s ON s.id = a.key
        LEFT JOIN (SELECT staff_id, arg_max(id, (opened_at, id)) AS shift_id FROM bk_shifts WHERE status = 'open' GROUP BY 1) h
               ON h.staff_id = a.staff_id"""
SALES = """cart_lines AS (
          SELECT parent_id AS cart_id, id AS line_id, product_id,
                 CASE WHEN parent_id % 31 = 0 AND quantity % 2 = 0 THEN 0 ELSE cast(ceil(quantity / 10) AS int) END AS quantity
          FROM sh_lines WHERE parent_id % 29 > 0),
        sized AS (SELECT cart_id, bool_or(quantity <= 0) AS bad FROM cart_lines GROUP BY 1),
        shift AS (SELECT staff_id, arg_max(id, (opened_at, id)) AS shift_id FROM bk_shifts WHERE status = 'open' GROUP BY 1),
        heads AS (
          SELECT c.*, shift_id, CASE WHEN z.cart_id IS NULL THEN 'no items' WHEN method = 'barter' THEN 'invalid method'
                 WHEN shift_id IS NULL THEN 'no open shift' WHEN z.bad THEN 'invalid item' END AS fault
          FROM (SELECT id AS cart_id, CASE WHEN id % 19 = 0 THEN id ELSE staff_id END AS staff_id, customer_id, created_at,
                       CASE WHEN id % 4 > 0 THEN discount_amount ELSE 0 END AS discount,
                       CASE WHEN id % 3 = 0 THEN 2 ELSE 5 END AS tax,
                       CASE WHEN id % 5 = 0 THEN balance_due END AS paid,
                       CASE WHEN id % 23 = 0 THEN 'barter' WHEN id % 2 = 0 THEN 'card' ELSE 'cash' END AS method
                FROM sh_sales) c
          LEFT JOIN sized z USING (cart_id) LEFT JOIN shift USING (staff_id)),
        """ + serial("""SELECT cart_id AS ref, heads.created_at AS moment, product_id AS key, quantity AS need, -quantity AS delta
              FROM cart_lines JOIN heads USING (cart_id) WHERE fault IS NULL""") + """,
        judged AS (SELECT h.*, coalesce(h.fault, CASE WHEN NOT s.ok THEN 'not enough stock' END) AS reason
          FROM heads h LEFT JOIN serial s ON s.ref = h.cart_id),
        sold AS (SELECT l.*, p.name, p.product_code,
                 CASE WHEN p.discount_percent > 0 THEN p.discount_price ELSE p.sale_price END AS price
          FROM cart_lines l JOIN judged j ON j.cart_id = l.cart_id AND j.reason IS NULL JOIN sh_products p ON p.id = l.product_id),
        billed AS (
          SELECT *, CASE WHEN paid IS NULL THEN total ELSE least(paid, total) END AS settled
          FROM (SELECT *, after + after * tax * 0.01 + after * 0.025 AS total
                FROM (SELECT j.*, s.subtotal, greatest(0, s.subtotal - j.discount) AS after FROM judged j
                      JOIN (SELECT cart_id, cast(sum(price * quantity) AS decimal(20,2)) AS subtotal FROM sold GROUP BY 1) s USING (cart_id)
                      WHERE j.reason IS NULL)))"""
check("create_sales", f"""SELECT cart_id AS id, shift_id, staff_id, customer_id, {cents('subtotal', 'subtotal')},
        {cents('discount', 'discount_amount')}, tax * 100 AS tax_percent, 250 AS service_charge_percent,
        {cents('round(total, 2)', 'total_amount')}, {cents('round(settled, 2)', 'amount_paid')},
        {cents('round(total - settled, 2)', 'balance_due')}, method AS payment_method, 'completed' AS status,
        {stamp('created_at', 'created_at')} FROM billed""", extra=SALES, recursive=True)
check("create_sales_items", f"""SELECT line_id AS id, cart_id AS sale_id, product_id, name AS product_name, product_code,
        {cents('price', 'price')}, quantity, 0 AS returned_quantity FROM sold""", extra=SALES, recursive=True)
check("create_sales_payments", f"""SELECT cart_id AS sale_id, shift_id, staff_id, {cents('round(settled, 2)', 'amount')},
        method, {stamp('created_at', 'created_at')} FROM billed WHERE round(settled, 2) > 0""", extra=SALES, recursive=True)
check("create_sales_moves", "SELECT product_id, cast(-sum(quantity) AS bigint) AS moved FROM sold GROUP BY 1",
      extra=SALES, recursive=True)
check("create_sales_refused", "SELECT cart_id, reason FROM judged WHERE reason IS NOT NULL", extra=SALES, recursive=True)

ASKED = """cart_lines AS (
          SELECT parent_id AS cart_id, id AS line_id, CASE WHEN parent_id % 17 = 0 THEN -product_id ELSE product_id END AS product_id,
                 CASE WHEN quantity < 5 THEN 1 ELSE cast(ceil(quantity / 8) AS int) END AS quantity
          FROM sh_lines WHERE parent_id % 29 > 0),
        judged AS (SELECT o.id AS cart_id, CASE WHEN f.cart_id IS NULL THEN 'no items' WHEN f.unknown THEN 'product not found'
              WHEN f.short THEN 'not enough stock' END AS reason
          FROM sh_orders o LEFT JOIN (SELECT l.cart_id, bool_or(p.id IS NULL) AS unknown, bool_or(p.stock < l.quantity) AS short
              FROM cart_lines l LEFT JOIN sh_products p ON p.id = l.product_id GROUP BY 1) f ON f.cart_id = o.id),
        placed AS (SELECT l.*, p.name, p.product_code,
                 CASE WHEN s.id IS NOT NULL THEN p.purchase_price ELSE p.discount_price END AS price
          FROM cart_lines l JOIN judged j ON j.cart_id = l.cart_id AND j.reason IS NULL JOIN sh_products p ON p.id = l.product_id
          LEFT JOIN sh_seller_orders s ON s.id = l.cart_id)"""
check("place_orders", f"""SELECT o.id, o.user_id, o.customer_id, {cents('t.total', 'total_amount')}, 'pending' AS status,
        'cod' AS payment_method, coalesce(o.shipping_name, u.name, c.name) AS shipping_name,
        coalesce(u.phone, c.whatsapp_number) AS shipping_phone, cast(NULL AS varchar) AS shipping_address,
        {stamp('o.created_at', 'created_at')}
        FROM sh_orders o JOIN (SELECT cart_id, sum(price * quantity) AS total FROM placed GROUP BY 1) t ON t.cart_id = o.id
        LEFT JOIN sh_users u ON u.id = o.user_id LEFT JOIN sh_customers c ON c.id = o.customer_id""", extra=ASKED)
check("place_orders_items", f"""SELECT line_id AS id, cart_id AS order_id, product_id, name AS product_name, product_code,
        {cents('price', 'price')}, quantity, 0 AS returned_quantity FROM placed""", extra=ASKED)
check("place_orders_refused", "SELECT cart_id, reason FROM judged WHERE reason IS NOT NULL", extra=ASKED)
check("apply_payments", """SELECT r.ref AS id, r.key AS sale_id, r.amount, cast(f.ok AS int) AS admitted,
        CASE WHEN NOT f.ok THEN coalesce(r.fault, 'more than the balance due') END AS reason
        FROM req r JOIN fold f ON f.key = r.key AND f.rn = r.rn""", extra=fold(PAY_REQ), recursive=True)
check("apply_payments_rows", f"""SELECT r.ref AS id, r.key AS sale_id, r.shift_id, r.staff_id, r.amount, r.method,
        {stamp('r.created_at', 'created_at')}
        FROM req r JOIN fold f ON f.key = r.key AND f.rn = r.rn WHERE f.ok""", extra=fold(PAY_REQ), recursive=True)
check("apply_payments_sales", f"""SELECT s.id AS sale_id, s.status, {cents('s.total_amount', 'total_amount')},
        cast(round(s.amount_paid * 100) AS bigint) + coalesce(p.paid, 0) AS amount_paid,
        cast(round(s.balance_due * 100) AS bigint) - coalesce(p.paid, 0) AS balance_due
        FROM bk_sales s LEFT JOIN (SELECT r.key, cast(sum(r.q) AS bigint) AS paid FROM req r
          JOIN fold f ON f.key = r.key AND f.rn = r.rn WHERE f.ok GROUP BY 1) p ON p.key = s.id""",
      extra=fold(PAY_REQ), recursive=True)
check("close_shifts", f"""SELECT id AS shift_id, staff_id, {cents('opening_cash', 'opening_cash')},
        {cents("CASE WHEN status = 'open' THEN opening_cash + staff_id ELSE closing_cash END", 'closing_cash')},
        {cents("CASE WHEN status = 'open' THEN expected_cash END", 'expected_cash')},
        {stamp("CASE WHEN status = 'open' THEN timestamp '2024-01-31' ELSE closed_at END", 'closed_at')},
        'closed' AS status, {cents('cash_out_total', 'cash_out_total')} FROM bk_expected""")
check("soft_delete_restore", """SELECT id, CASE WHEN id IN (SELECT product_id FROM sh_lines) THEN 1
        WHEN id NOT IN (SELECT l.product_id FROM sh_lines l JOIN sh_orders o ON o.id = l.parent_id WHERE o.status = 'successful')
        THEN 0 ELSE is_active END AS is_active FROM sh_products""")
check("partial_update", """SELECT id, CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS name,
        CASE WHEN id % 4 = 0 THEN 'new' || id || '@mail.test' WHEN id % 2 = 0 THEN NULL ELSE email END AS email
        FROM sh_customers""")
check("wishlist_toggle", "SELECT owner_type, owner_id, product_id, count(*) AS toggles FROM wishes GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1",
      extra=WISHES)
check("approve_reject", """SELECT u.id, CASE WHEN d.yes IS NULL THEN u.status WHEN d.yes THEN 'approved' ELSE 'rejected' END AS status,
        coalesce(cast(d.yes AS int), u.is_active) AS is_active
        FROM sh_users u LEFT JOIN (SELECT user_id % 40 AS id, arg_max(k % 2 = 0, ts) AS yes FROM bk_events
          WHERE event_type = 'signup' GROUP BY 1) d ON d.id = u.id""")
check("backfills", f"""SELECT id, {cents('total_amount', 'total_amount')}, {cents('total_amount', 'amount_paid')},
        cast(0 AS bigint) AS balance_due FROM bk_sales""")
check("backfill_legal_text", """SELECT id, coalesce(shop_name, 'Update Soon') AS terms_content,
        'Update Soon' AS return_policy_content, coalesce(city, 'Update Soon') AS privacy_policy_content,
        coalesce(phone, 'Update Soon') AS about_content FROM sh_users""")
check("backfill_codes_by_slug", "SELECT id, coalesce(product_code, 'S' || id) AS product_code FROM sh_products")
check("price_migration", f"""SELECT id, 0 AS purchase_price, {cents('sale_price', 'sale_price')}, pct AS discount_percent,
        {cents('round(sale_price - sale_price * cast(pct * 0.01 AS decimal(7,2)) * 0.01, 2)', 'discount_price')}
        FROM (SELECT id, sale_price, CASE WHEN discount_percent > 0 THEN {_implied('sale_price', 'discount_price')} ELSE 0 END AS pct
              FROM sh_products)""")
check("role_migration", """SELECT id, CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END AS role_id FROM sh_users""")
check("ensure_columns", """SELECT id, name, whatsapp_number, 1 AS is_active, cast(NULL AS varchar) AS city FROM sh_customers""")

# --- streams ----------------------------------------------------------------

check("stream_x_report", f"""SELECT shift_id, count(*) FILTER (status = 'completed') AS transaction_count,
        {cents("coalesce(sum(total_amount) FILTER (status = 'completed'), 0)", 'total_sales')},
        {cents("coalesce(sum(discount_amount) FILTER (status = 'completed'), 0)", 'total_discount')},
        {cents("coalesce(sum(balance_due) FILTER (status = 'completed'), 0)", 'total_balance_due')},
        {cents("coalesce(sum(amount_paid) FILTER (payment_method = 'cash' AND status <> 'voided'), 0)", 'cash_collected')},
        {cents("coalesce(sum(cash_out), 0)", 'cash_out_total')}
        FROM (SELECT shift_id, status, total_amount, discount_amount, balance_due, amount_paid, payment_method,
                     cast(NULL AS decimal(10,2)) AS cash_out FROM bk_sales
              UNION ALL SELECT shift_id, NULL, NULL, NULL, NULL, NULL, NULL, amount FROM bk_cash) GROUP BY 1""")
check("stream_shift_reports", f"""SELECT h.id AS shift_id, {cents('h.opening_cash', 'opening_cash')}, h.status,
        coalesce(f.n, 0) AS transaction_count, {cents('coalesce(f.t, 0)', 'total_sales')},
        {cents('coalesce(f.dis, 0)', 'total_discount')}, {cents('coalesce(f.b, 0)', 'total_balance_due')},
        coalesce(p.payments, '') AS payments, {cents('h.cash_collected', 'cash_collected')},
        {cents('h.cash_out_total', 'cash_out_total')}, {cents('h.closing_cash', 'closing_cash')},
        {cents('h.expected_cash', 'expected_cash')}, {cents('h.closing_cash - h.expected_cash', 'variance')}
        FROM bk_expected h
        LEFT JOIN (SELECT shift_id, count(*) AS n, sum(total_amount) AS t, sum(discount_amount) AS dis,
                          sum(balance_due) AS b FROM bk_sales WHERE status = 'completed' GROUP BY 1) f ON f.shift_id = h.id
        LEFT JOIN (SELECT shift_id, string_agg(method || ':' || cast(round(t * 100) AS bigint), '|' ORDER BY method) AS payments
                   FROM (SELECT shift_id, method, sum(amount) AS t FROM bk_valid GROUP BY 1, 2) GROUP BY 1) p
               ON p.shift_id = h.id""")
check("stream_revenue_by_day", f"""SELECT {day('created_at')}, {cents('sum(total_amount)', 'revenue')} FROM bk_sales
        WHERE status = 'completed' GROUP BY 1""")
check("stream_hot_products", """SELECT cast(until AS varchar) AS until, product_id, total_sold, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY until ORDER BY total_sold DESC, product_id) AS rank FROM (
          SELECT day + 1 + cast(i AS int) AS until, user_id AS product_id, cast(sum(k) AS bigint) AS total_sold
          FROM (SELECT * FROM bk_events WHERE event_type = 'purchase'), range(7) t(i) GROUP BY 1, 2)) WHERE rank <= 5""")
check("stream_ttl_state", """SELECT user_id AS identifier, purpose, event_id, outcome FROM walk""", recursive=True,
      extra="""req AS MATERIALIZED (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'register' ELSE 'reset' END AS purpose,
            event_id, cast(floor(epoch(ts)) AS bigint) AS now, event_type IN ('signup', 'view') AS asks, k % 4 = 0 AS correct,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM bk_events),
        walk AS (SELECT user_id, purpose, event_id, rn, CASE WHEN asks THEN 'sent' ELSE 'none' END AS outcome,
                CASE WHEN asks THEN now END AS made, 0 AS tried FROM req WHERE rn = 1
            UNION ALL
            SELECT user_id, purpose, event_id, rn, outcome,
                CASE outcome WHEN 'sent' THEN now WHEN 'refused' THEN made WHEN 'wrong' THEN made END,
                CASE outcome WHEN 'refused' THEN tried WHEN 'wrong' THEN tried + 1 ELSE 0 END
            FROM (SELECT r.*, w.made, w.tried, CASE
                    WHEN r.asks AND w.made IS NOT NULL AND r.now - w.made < 3600 THEN 'refused'
                    WHEN r.asks THEN 'sent'
                    WHEN w.made IS NULL THEN 'none'
                    WHEN w.made + 36000 < r.now THEN 'expired'
                    WHEN w.tried >= 2 THEN 'too many'
                    WHEN NOT r.correct THEN 'wrong' ELSE 'ok' END AS outcome
                  FROM walk w JOIN req r ON r.user_id = w.user_id AND r.rn = w.rn + 1))""")
check("stream_dedupe", f"SELECT event_id, user_id, event_type, {cents('v', 'v')} FROM bk_events")
check("stream_dedupe_upsert", f"""SELECT identifier, purpose, payload, {stamp('ts', 'ts')} FROM (
        SELECT user_id AS identifier, k % 3 AS purpose, event_id AS payload, ts,
               row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY ts DESC, event_id DESC) AS rn
        FROM bk_events WHERE event_type IN ('view', 'signup')) WHERE rn = 1""")
check("stream_stock", """SELECT product_id, moved, cast(p.stock + moved AS bigint) AS balance FROM (SELECT user_id AS product_id,
        cast(sum(CASE WHEN event_type = 'purchase' THEN -(k // 10 + 1) ELSE 5 END) AS bigint) AS moved
        FROM bk_events WHERE event_type IN ('purchase', 'signup') GROUP BY 1) JOIN sh_products p ON p.id = product_id""")
SESSIONS = f"""SELECT staff_id, {stamp('min(ts)', 'opened_at')}, {stamp('max(ts) + INTERVAL 4 HOUR', 'closed_at')},
        count(*) AS events, max(ts) + INTERVAL 4 HOUR AS ends FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY staff_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
          SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY staff_id ORDER BY ts, event_id) + INTERVAL 4 HOUR
                         THEN 1 ELSE 0 END AS fresh FROM bk_events)) GROUP BY staff_id, session"""
check("session_shifts", f"SELECT * EXCLUDE (ends) FROM ({SESSIONS})")
check("stream_session_shifts", f"SELECT * EXCLUDE (ends) FROM ({SESSIONS})")
