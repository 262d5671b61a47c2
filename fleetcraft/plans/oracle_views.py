"""The fixture mapping as DuckDB SQL (independent oracle for every query).

Each logical table is one CTE over the pre-registered raw views. ``with_views``
prefixes a query body with the CTEs it names, in dependency order.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "workers": """
        SELECT c_custkey AS driver_id, c_name AS driver_uuid FROM customer""",
    "accounts": """
        SELECT c.c_custkey AS driver_id, c.c_name AS driver_uuid, 'co' AS tenant,
               n.n_name AS logistic_region
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "segmentation": """
        SELECT c.c_custkey AS driver_id, c.c_mktsegment AS segment,
               TIMESTAMP '2024-01-30 00:00:00' AS segmentation_date, n.n_name AS logistic_region
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "wallet_orders": """
        SELECT o.o_custkey AS driver_id, o.o_orderkey AS order_number,
               o.o_orderdate AS date_timestamp, CAST(o.o_orderdate AS DATE) AS date_partition,
               CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'MONEY' ELSE o.o_orderpriority END
                   AS payment_type,
               o.o_totalprice - 250000.0 AS wallet_before_order, n.n_name AS logistic_region
        FROM orders o LEFT JOIN nation n ON CAST(o.o_orderkey % 25 AS INTEGER) = n.n_nationkey""",
    "deliveries": """
        SELECT o.o_custkey AS driver_id, c.c_name AS driver_uuid, l.l_orderkey AS order_uuid,
               l.l_orderkey * 10 + l.l_linenumber AS order_delivery_uuid,
               l.l_orderkey AS order_number, o.o_orderstatus AS last_status,
               DATE '2023-12-20' + CAST(l.l_orderkey % 45 AS INTEGER) AS date_partition,
               upper(n.n_name) AS logistic_region,
               CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS DOUBLE)
                   AS delay,
               l.l_discount AS driver_consumer_evaluation, l.l_quantity AS real_delivery_time,
               25.0 AS expected_delivery_time,
               CASE WHEN l.l_linestatus = 'F' THEN 'true' ELSE 'false' END AS late_driver_flag,
               CASE WHEN o.o_custkey % 7 = 0 THEN 0.0 ELSE l.l_tax * 3600 END AS time_to_destination, l.l_quantity AS distance_route
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
        LEFT JOIN nation n ON n.n_nationkey =
            CASE WHEN l.l_linenumber % 2 = 0 THEN s.s_nationkey ELSE o.o_custkey % 25 END""",
    "routes": """
        SELECT o.o_custkey AS driver_id, DATE '2023-12-20' + CAST(l.l_orderkey % 45 AS INTEGER) AS date_partition,
               nullif(l.l_returnflag, 'N') AS cancel_rejection_type
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "worker_registration": """
        SELECT f.o_custkey AS worker_id,
               CASE WHEN f.o_custkey % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS worker_state,
               CAST(DATE '2023-12-20' + CAST(f.o_custkey % 60 AS INTEGER) AS TIMESTAMP) AS registration_timestamp,
               CAST(DATE '2023-12-20' + CAST(f.o_custkey % 60 AS INTEGER) AS TIMESTAMP)
                   AS registration_approval_timestamp,
               n.n_name AS logistic_region
        FROM (SELECT DISTINCT o_custkey FROM orders) f
        LEFT JOIN nation n ON CAST(f.o_custkey % 25 AS INTEGER) = n.n_nationkey""",
    "billing": """
        SELECT e.user_id AS driver_id, c.c_name AS driver_uuid, CAST(e.ts AS DATE) AS day,
               e.event_type AS billing_cause, e.value * 100 AS quantity, e.event_id AS id
        FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "daily_wallet": """
        SELECT user_id AS driver_id, CAST(ts AS DATE) + 1 AS date_data, value - 50 AS wallet
        FROM events""",
    "strikes": """
        SELECT user_id AS driver_id, CAST(ts AS DATE) AS created_date,
               event_type AS strike_classification, event_id AS strike_id
        FROM events""",
    "supply_intervals": """
        SELECT e.user_id AS driver_id, c.c_name AS driver_uuid, CAST(e.ts AS DATE) AS date_partition,
               e.ts AS interval_start_timestamp, e.value * 60 AS interval_executed_seconds,
               e.value * 30 AS interval_worked_seconds
        FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "wallet_streak": """
        SELECT user_id AS driver_id, CAST(ts AS DATE) AS date_partition,
               CAST(sign(value - 50) AS DOUBLE) AS sign
        FROM events""",
    "coordinates": """
        SELECT c_custkey AS id,
               CASE c_custkey % 6 WHEN 0 THEN 4 + c_custkey % 7 WHEN 1 THEN -74 - c_custkey % 5
                    WHEN 2 THEN 4 + c_custkey % 7 WHEN 3 THEN -(-74 - c_custkey % 5)
                    WHEN 4 THEN -40 ELSE NULL END::DOUBLE AS latitud,
               CASE c_custkey % 6 WHEN 0 THEN -74 - c_custkey % 5 WHEN 1 THEN 4 + c_custkey % 7
                    WHEN 2 THEN -(-74 - c_custkey % 5) WHEN 3 THEN 4 + c_custkey % 7
                    ELSE 10 END::DOUBLE AS longitud
        FROM customer""",
}

# Views that other views read.
DEPENDS: dict[str, tuple[str, ...]] = {}


def initcap(expr: str) -> str:
    """Spark's ``initcap`` (first letter of each space-separated word upper, rest lower)."""
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            f"lambda w: upper(w[1:1]) || w[2:]), ' ')")


def round_mean(expr: str, digits: int) -> str:
    """Order-independent ``round(avg(x), digits)``, same as the Spark helper."""
    return (f"CAST(round(CAST(sum(CAST({expr} AS DECIMAL(38,10))) / count({expr}) AS DECIMAL(38,14)), "
            f"{digits}) AS DOUBLE)")


def money_sum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(38,6))) AS DOUBLE)"


def money_mean(expr: str) -> str:
    return f"(CAST(sum(CAST({expr} AS DECIMAL(38,6))) AS DOUBLE) / nullif(count({expr}), 0))"


def with_views(names: list[str] | tuple[str, ...], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH <views>, <extra ctes> <body>``; views are pulled in with their dependencies."""
    order: list[str] = []

    def add(n: str):
        for d in DEPENDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in order] + [f"{n} AS ({sql.strip()})" for n, sql in extra]
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
