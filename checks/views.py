"""The shop's tables as SQL over the benchmark tables, for the independent check."""

from __future__ import annotations

import re

BRAND = "cast(replace(p_brand, 'Brand#', '') AS int)"
TYPE_NO = "list_position(['ECONOMY','STANDARD','PROMO','SMALL','MEDIUM','LARGE'], p_type)"

VIEWS: dict[str, str] = {
    "sh_products": f"""
        SELECT *, cast(round(sale_price * 0.70, 2) AS decimal(10,2)) AS purchase_price,
               cast(round(sale_price - sale_price * discount_percent * 0.01, 2) AS decimal(10,2)) AS discount_price
        FROM (SELECT p_partkey AS id, {BRAND} AS category_id,
                     cast({BRAND} * 10 + {TYPE_NO} AS int) AS subcategory_id,
                     p_name AS name,
                     replace(lower(trim(p_name)), ' ', '-') || '-' || p_partkey AS slug,
                     CASE p_partkey % 10 WHEN 3 THEN NULL WHEN 7 THEN 'TB-' || p_partkey
                          ELSE cast(1000 + p_partkey AS varchar) END AS product_code,
                     cast(p_retailprice AS decimal(10,2)) AS sale_price,
                     cast((p_size % 4) * 5 AS decimal(5,2)) AS discount_percent,
                     p_size - 1 AS stock,
                     cast(p_partkey % 10 = 0 AS int) AS featured,
                     cast(p_partkey % 20 <> 0 AS int) AS is_active,
                     timestamp '2000-01-01' + to_days(cast(p_partkey AS int)) AS created_at
              FROM part)""",
    "sh_categories": f"""
        SELECT id, name, 'brand-' || id AS slug, cast(id % 10 <> 0 AS int) AS is_active,
               timestamp '2000-01-01' + to_days(id) AS created_at
        FROM (SELECT DISTINCT {BRAND} AS id, p_brand AS name FROM part)""",
    "sh_subcategories": f"""
        SELECT id, category_id, name, 'brand-' || category_id || '-' || lower(name) AS slug,
               cast(category_id % 10 <> 0 AS int) AS is_active,
               timestamp '2000-01-01' + to_days(id) AS created_at
        FROM (SELECT DISTINCT cast({BRAND} * 10 + {TYPE_NO} AS int) AS id, {BRAND} AS category_id,
                     p_type AS name FROM part)""",
    "sh_customers": """
        SELECT c_custkey AS id, c_name AS name,
               CASE WHEN c_custkey = 0 THEN 'anonymous-guest'
                    ELSE '94' || lpad(cast(c_custkey AS varchar), 9, '0') END AS whatsapp_number,
               CASE WHEN c_custkey % 3 = 0 THEN NULL
                    ELSE lower(c_mktsegment) || c_custkey || '@mail.test' END AS email,
               cast(c_custkey % 15 <> 0 AS int) AS is_active,
               timestamp '2000-01-01' + to_days(cast(c_custkey AS int)) AS created_at
        FROM customer""",
    "sh_users": """
        SELECT s_suppkey AS id, s_name AS name,
               CASE WHEN s_suppkey = 0 THEN 'anonymous-seller@internal.local'
                    ELSE 'staff' || s_suppkey || '@shop.test' END AS email,
               CASE WHEN s_suppkey % 5 = 0 THEN '94' || lpad(cast(s_suppkey AS varchar), 9, '0')
                    ELSE '77' || lpad(cast(s_suppkey AS varchar), 7, '0') END AS phone,
               CASE WHEN s_suppkey % 3 = 0 THEN 'Shop ' || s_suppkey END AS shop_name,
               'City ' || s_nationkey AS city,
               CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS role_id,
               CASE s_suppkey % 7 WHEN 5 THEN 'pending' WHEN 6 THEN 'rejected' ELSE 'approved' END AS status,
               cast(s_suppkey % 7 < 5 AS int) AS is_active,
               timestamp '2000-01-01' + to_days(cast(s_suppkey AS int)) AS created_at
        FROM supplier""",
    "sh_roles": """
        SELECT * FROM (VALUES (1,'SuperAdmin'),(2,'Admin'),(3,'Seller'),(4,'Customer'),(5,'Staff')) t(id, name)""",
    "sh_orders": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 10 END AS user_id,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS customer_id,
               cast(o_totalprice AS decimal(10,2)) AS total_amount,
               CASE o_orderstatus WHEN 'F' THEN 'successful' WHEN 'O' THEN 'pending'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'return' ELSE 'cancelled' END END AS status,
               'cod' AS payment_method,
               CASE WHEN o_orderkey % 3 <> 0 THEN 'Receiver ' || o_custkey END AS shipping_name,
               o_orderdate AS created_at
        FROM orders WHERE o_orderpriority < '4'""",
    "sh_sales": """
        SELECT *, cast(total_amount - amount_paid AS decimal(10,2)) AS balance_due
        FROM (SELECT *, cast(CASE WHEN id % 4 = 0 THEN round(total_amount * 0.5, 2) ELSE total_amount END
                        AS decimal(10,2)) AS amount_paid
              FROM (SELECT *, cast(subtotal - discount_amount AS decimal(10,2)) AS total_amount
                    FROM (SELECT o_orderkey AS id, o_custkey % 10 AS staff_id, o_custkey AS customer_id,
                                 cast(o_totalprice AS decimal(10,2)) AS subtotal,
                                 cast(round(cast(o_totalprice AS decimal(10,2)) * cast(o_orderkey % 5 AS int) * 0.01, 2)
                                      AS decimal(10,2)) AS discount_amount,
                                 CASE WHEN o_orderstatus <> 'P' THEN 'completed'
                                      WHEN o_orderkey % 2 = 0 THEN 'voided' ELSE 'returned' END AS status,
                                 ['cash','card','cheque'][cast(o_orderkey % 3 AS int) + 1] AS payment_method,
                                 o_orderdate AS created_at
                          FROM orders WHERE o_orderpriority >= '4')))""",
    "sh_lines": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
               l_orderkey AS parent_id, l_linenumber AS line_no, l_partkey AS product_id,
               'Item ' || l_partkey AS product_name,
               CASE WHEN l_partkey % 10 = 4 THEN NULL ELSE cast(1000 + l_partkey AS varchar) END AS product_code,
               cast(round(cast(l_extendedprice AS decimal(12,2)) * 0.01, 2) AS decimal(10,2)) AS price,
               cast(l_quantity AS int) AS quantity,
               cast(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN floor(l_quantity * 0.5)
                    ELSE 0 END AS int) AS returned_quantity
        FROM lineitem""",
    "sh_combined": """
        SELECT l.product_id, l.quantity, h.created_at FROM sh_lines l JOIN sh_orders h ON h.id = l.parent_id
        WHERE h.status = 'successful'
        UNION ALL
        SELECT l.product_id, l.quantity, h.created_at FROM sh_lines l JOIN sh_sales h ON h.id = l.parent_id
        WHERE h.status = 'completed'""",
    "sh_named": """
        SELECT p.*, c.name AS category_name, c.slug AS category_slug,
               s.name AS subcategory_name, s.slug AS subcategory_slug
        FROM sh_products p LEFT JOIN sh_categories c ON c.id = p.category_id
        LEFT JOIN sh_subcategories s ON s.id = p.subcategory_id""",
    "sh_seller_orders": """
        SELECT o.* FROM sh_orders o JOIN sh_users u ON u.id = o.user_id
        JOIN sh_roles r ON r.id = u.role_id AND r.name = 'Seller'""",
    "bk_events": """
        SELECT event_id, ts, user_id, event_type, cast(ts AS date) AS day, user_id % 10 AS staff_id,
               cast(value AS decimal(10,2)) AS v, cast(json_extract_string(props, '$.k') AS int) AS k,
               date_diff('day', date '2024-01-01', cast(ts AS date)) * 10 + user_id % 10 AS shift_id
        FROM events""",
    "bk_sales": """
        SELECT id, shift_id, staff_id, customer_id, subtotal, discount_amount, payment_method, status, created_at,
               total_amount, amount_paid, cast(total_amount - amount_paid AS decimal(10,2)) AS balance_due
        FROM (SELECT *, cast(CASE WHEN k % 4 = 0 THEN round(subtotal * 0.5, 2) ELSE total_amount END
                        AS decimal(10,2)) AS amount_paid
              FROM (SELECT *, cast(subtotal - discount_amount AS decimal(10,2)) AS total_amount
                    FROM (SELECT event_id AS id, shift_id, staff_id, user_id AS customer_id, v AS subtotal,
                                 cast(round(v * (k % 5) * 0.01, 2) AS decimal(10,2)) AS discount_amount, k,
                                 ['cash','card','cheque'][cast(event_id % 3 AS int) + 1] AS payment_method,
                                 CASE k % 10 WHEN 0 THEN 'voided' WHEN 1 THEN 'returned' ELSE 'completed' END AS status,
                                 ts AS created_at
                          FROM bk_events WHERE event_type = 'purchase')))""",
    "bk_owed": """
        SELECT customer_id, created_at AS first_ts, id AS sale_id FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) AS rn
            FROM bk_sales WHERE balance_due > 0) WHERE rn = 1""",
    "bk_late": """
        SELECT e.event_id AS id, o.sale_id, e.shift_id, e.staff_id,
               cast(round(e.v * 0.1, 2) AS decimal(10,2)) AS amount, 'cash' AS method, e.ts AS created_at
        FROM bk_events e JOIN bk_owed o ON o.customer_id = e.user_id
        WHERE e.event_type = 'click' AND e.event_id % 5 = 0 AND e.ts > o.first_ts""",
    "bk_payments": """
        SELECT id, id AS sale_id, shift_id, staff_id, amount_paid AS amount, payment_method AS method, created_at
        FROM bk_sales
        UNION ALL SELECT id, sale_id, shift_id, staff_id, amount, method, created_at FROM bk_late""",
    "bk_cash": """
        SELECT event_id AS id, shift_id, staff_id, cast(round(v * 0.1, 2) AS decimal(10,2)) AS amount,
               ['Salary','Delivery','Collection','Lunch','Other'][k % 5 + 1] AS reason,
               CASE WHEN k % 2 = 0 THEN 'note ' || k END AS note, ts AS created_at
        FROM bk_events WHERE event_type = 'error'""",
    "bk_shifts": """
        SELECT shift_id AS id, staff_id, cast(100 + staff_id AS decimal(10,2)) AS opening_cash, opened_at,
               CASE WHEN day < last_day THEN cast(100 + staff_id + day(day) * 20 AS decimal(10,2)) END AS closing_cash,
               CASE WHEN day < last_day THEN cast(day + 1 AS timestamp) END AS closed_at,
               CASE WHEN day < last_day THEN 'closed' ELSE 'open' END AS status
        FROM (SELECT shift_id, staff_id, day, min(ts) AS opened_at FROM bk_events GROUP BY 1, 2, 3),
             (SELECT max(day) AS last_day FROM bk_events)""",
    "bk_valid": """
        SELECT p.* FROM bk_payments p JOIN bk_sales s ON s.id = p.sale_id WHERE s.status <> 'voided'""",
    "bk_expected": """
        SELECT h.*, coalesce(p.cash, 0) AS cash_collected, coalesce(m.out, 0) AS cash_out_total,
               h.opening_cash + coalesce(p.cash, 0) - coalesce(m.out, 0) AS expected_cash
        FROM bk_shifts h
        LEFT JOIN (SELECT shift_id, sum(amount) AS cash FROM bk_valid WHERE method = 'cash' GROUP BY 1) p
               ON p.shift_id = h.id
        LEFT JOIN (SELECT shift_id, sum(amount) AS out FROM bk_cash GROUP BY 1) m ON m.shift_id = h.id""",
}

_NAMES = re.compile(r"\b((?:sh|bk)_[a-z_]+)\b")


def with_views(body: str, extra: str = "", recursive: bool = False) -> str:
    """The statement with the views it needs, in definition order."""
    needed: set[str] = set()
    todo = [body, extra]
    while todo:
        for name in _NAMES.findall(todo.pop()):
            if name in VIEWS and name not in needed:
                needed.add(name)
                todo.append(VIEWS[name])
    parts = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in needed]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


def cents(expr: str, name: str) -> str:
    return f"cast(round(({expr}) * 100) AS bigint) AS {name}"


def stamp(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def day(expr: str, name: str = "day") -> str:
    return f"cast(cast({expr} AS date) AS varchar) AS {name}"
