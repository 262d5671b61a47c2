"""Per-driver aggregate queries (R1-R7, K1-K8, W1) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcraft.operators import features as feat
from fleetcraft.plans.settings import (CODES, EVENTS_15, EVENTS_30, NEW_DRIVER_AS_OF, ORDERS_WINDOW,
                                        RECHARGE_CAUSES, SENIORITY_AS_OF, STRIKE_EXCLUDED, FEATURE_END,
                                        fixtures, register)
from fleetcraft.plans.oracle_views import initcap, money_mean, money_sum, round_mean, with_views

_causes = ", ".join(f"'{c}'" for c in RECHARGE_CAUSES)
_excluded = ", ".join(f"'{c}'" for c in STRIKE_EXCLUDED)


@register("recharges_per_driver", with_views(["billing"], f"""
    SELECT driver_id, count(id) AS recharges, {money_mean('quantity / 100.0')} AS avg_recharge,
           count(DISTINCT day) AS days_with_recharges, {money_sum('quantity / 100.0')} AS total_recharges
    FROM billing
    WHERE {EVENTS_30.sql('day')} AND billing_cause IN ({_causes})
    GROUP BY driver_id"""))
def recharges_per_driver(spark, sf):
    return feat.recharges(fixtures(spark, sf).billing(), EVENTS_30, RECHARGE_CAUSES)


@register("order_stats_per_driver", with_views(["wallet_orders"], f"""
    SELECT driver_id,
           avg(CASE WHEN wallet_before_order < 0 THEN 1 ELSE 0 END) AS perc_negative_orders,
           avg(CASE WHEN payment_type = 'MONEY' THEN 1 ELSE 0 END) AS perc_cash_orders,
           count(order_number) AS orders,
           arg_min(logistic_region, (date_timestamp, order_number)) AS logistic_region
    FROM wallet_orders
    WHERE {ORDERS_WINDOW.sql('date_partition')}
    GROUP BY driver_id"""))
def order_stats_per_driver(spark, sf):
    return feat.order_stats(fixtures(spark, sf).wallet_orders(), ORDERS_WINDOW)


_LONG_NUMBER = "(CASE WHEN order_number % 5 = 0 THEN NULL ELSE 1900000000000000000 - order_number * 1000 END)"


@register("order_stats_long_numbers", with_views(["wallet_orders"], f"""
    SELECT driver_id,
           avg(CASE WHEN wallet_before_order < 0 THEN 1 ELSE 0 END) AS perc_negative_orders,
           avg(CASE WHEN payment_type = 'MONEY' THEN 1 ELSE 0 END) AS perc_cash_orders,
           count(n) AS orders,
           arg_min(logistic_region, (t, n IS NULL, coalesce(n, 0), logistic_region)) AS logistic_region
    FROM (SELECT *, {_LONG_NUMBER} AS n, to_microseconds(order_number % 2) + TIMESTAMP '1996-05-05 00:00:00' AS t
          FROM wallet_orders)
    GROUP BY driver_id"""))
def order_stats_long_numbers(spark, sf):
    """R2 and A9 with 19-digit and missing order numbers, a driver's orders at two times a microsecond apart."""
    o = fixtures(spark, sf).wallet_orders()
    at = F.timestamp_micros(F.lit(831_254_400_000_000) + F.col("order_number") % 2)
    return feat.order_stats(o.withColumn("date_timestamp", at).withColumn("order_number", F.expr(_LONG_NUMBER)), None)


@register("wallet_stats", with_views(["daily_wallet"], f"""
    SELECT driver_id, CAST(sum(CASE WHEN wallet < 0 THEN 1 ELSE 0 END) AS BIGINT) AS days_negative,
           {money_mean('wallet')} AS avg_wallet, min(wallet) AS min_wallet
    FROM daily_wallet
    WHERE {EVENTS_30.sql('date_data - 1')}
    GROUP BY driver_id"""))
def wallet_stats(spark, sf):
    return feat.wallet_stats(fixtures(spark, sf).daily_wallet(), EVENTS_30)


@register("strikes_windowed", with_views(["strikes"], f"""
    SELECT driver_id, count(DISTINCT strike_id) AS strikes
    FROM strikes
    WHERE {EVENTS_15.sql('created_date')} AND strike_classification NOT IN ({_excluded})
    GROUP BY driver_id"""))
def strikes_windowed(spark, sf):
    return feat.strikes_windowed(fixtures(spark, sf).strikes(), EVENTS_15, STRIKE_EXCLUDED)


@register("strikes_all_history", with_views(["strikes", "workers"], f"""
    SELECT w.driver_uuid, count(DISTINCT s.strike_id) AS strikes
    FROM strikes s LEFT JOIN workers w ON s.driver_id = w.driver_id
    WHERE s.created_date <= DATE '{FEATURE_END}' AND s.strike_classification NOT IN ({_excluded})
    GROUP BY w.driver_uuid"""))
def strikes_all_history(spark, sf):
    t = fixtures(spark, sf)
    return feat.strikes_history(t.strikes(), t.workers(), FEATURE_END, STRIKE_EXCLUDED)


@register("seniority", with_views(["deliveries"], f"""
    SELECT driver_id, min(date_partition) AS first_order, DATE '{SENIORITY_AS_OF}' AS as_of,
           CAST(date_diff('day', min(date_partition), DATE '{SENIORITY_AS_OF}') AS INTEGER) AS seniority_days
    FROM deliveries
    WHERE last_status = '{CODES.completed}' AND date_partition <= DATE '{SENIORITY_AS_OF}'
    GROUP BY driver_id"""))
def seniority(spark, sf):
    return feat.seniority(fixtures(spark, sf).deliveries(with_uuid=False), SENIORITY_AS_OF, CODES)


@register("online_hours", with_views(["supply_intervals"], f"""
    SELECT driver_id, sum(interval_executed_seconds / 3600) AS online_hours,
           sum(interval_worked_seconds / 3600) AS working_hours
    FROM supply_intervals
    WHERE {EVENTS_30.sql('date_partition')}
    GROUP BY driver_id"""))
def online_hours(spark, sf):
    return feat.online_hours(fixtures(spark, sf).supply_intervals(), EVENTS_30)


_ROUTE_SHARES = """
    SELECT {key}, completed_routes, total_routes,
           completed_routes / nullif(total_routes, 0)::DOUBLE AS prop_completed_routes,
           1.0 - completed_routes / nullif(total_routes, 0)::DOUBLE AS prop_declined_orders
    FROM c"""


@register("route_completion", with_views(["routes"], _ROUTE_SHARES.format(key="driver_id"), extra=[("c", """
        SELECT driver_id,
               CAST(sum(CASE WHEN coalesce(cancel_rejection_type, 'completed') = 'completed' THEN 1 ELSE 0 END)
                    AS BIGINT) AS completed_routes,
               count(coalesce(cancel_rejection_type, 'completed')) AS total_routes
        FROM routes WHERE """ + EVENTS_30.sql("date_partition") + " GROUP BY driver_id")]))
def route_completion(spark, sf):
    return feat.route_completion(fixtures(spark, sf).routes(), EVENTS_30)


@register("route_completion_by_uuid", with_views(["routes", "workers"], _ROUTE_SHARES.format(key="driver_uuid"),
                                                 extra=[("c", """
        SELECT w.driver_uuid,
               CAST(sum(CASE WHEN coalesce(r.cancel_rejection_type, 'completed') = 'completed' THEN 1 ELSE 0 END)
                    AS BIGINT) AS completed_routes,
               count(coalesce(r.cancel_rejection_type, 'completed')) AS total_routes
        FROM routes r LEFT JOIN workers w ON r.driver_id = w.driver_id
        WHERE """ + EVENTS_30.sql("r.date_partition") + " GROUP BY w.driver_uuid")]))
def route_completion_by_uuid(spark, sf):
    t = fixtures(spark, sf)
    return feat.route_completion_by_uuid(t.routes(), t.workers(), EVENTS_30)


@register("new_drivers", with_views(["worker_registration", "workers", "deliveries"], """
    SELECT y.driver_uuid, y.logistic_region, coalesce(o.orders, 0) AS orders, y.antiquity
    FROM young y LEFT JOIN o ON y.driver_uuid = o.driver_uuid
    WHERE y.antiquity <= 30 AND coalesce(o.orders, 0) <= 5""", extra=[("young", f"""
        SELECT w.driver_uuid, {initcap('trim(r.logistic_region)')} AS logistic_region,
               CAST(date_diff('day', CAST(r.registration_approval_timestamp AS DATE), DATE '{NEW_DRIVER_AS_OF}')
                    AS INTEGER) AS antiquity
        FROM worker_registration r LEFT JOIN workers w ON w.driver_id = r.worker_id
        WHERE r.worker_state = 'ACTIVE'"""), ("o", f"""
        SELECT driver_uuid, count(DISTINCT order_uuid) AS orders FROM deliveries
        WHERE date_partition <= DATE '{NEW_DRIVER_AS_OF}' GROUP BY driver_uuid""")]))
def new_drivers(spark, sf):
    t = fixtures(spark, sf)
    return feat.new_drivers(t.worker_registration(), t.workers(), t.deliveries(), NEW_DRIVER_AS_OF)


# Delivery facts (K2) as SQL, shared by the delivery-based oracles.
FACTS_SQL = f"""
    SELECT driver_id, driver_uuid, order_uuid, order_delivery_uuid, date_partition,
           {initcap('trim(logistic_region)')} AS logistic_region, driver_consumer_evaluation,
           CASE WHEN delay > 300 THEN 1 ELSE 0 END AS is_critical_delay,
           CASE WHEN real_delivery_time <= expected_delivery_time THEN 1 ELSE 0 END AS is_ontime,
           CASE WHEN late_driver_flag = 'true' THEN 1 ELSE 0 END AS driver_delay_origin,
           time_to_destination / 3600 AS time_to_destination_hours,
           distance_route / nullif(time_to_destination / 3600, 0) AS speed
    FROM deliveries
    WHERE last_status <> '{CODES.cancelled}' AND driver_uuid IS NOT NULL AND {EVENTS_15.sql('date_partition')}"""


def _daily(t):
    return feat.daily_by_uuid(feat.supply_daily(t.supply_intervals(), EVENTS_15, "driver_id"), t.workers())


def _facts(spark, sf):
    return feat.delivery_facts(fixtures(spark, sf).deliveries(), EVENTS_15, CODES)


@register("delivery_kpis", with_views(["deliveries"], f"""
    SELECT driver_uuid,
           {round_mean('is_critical_delay', 4)} AS prop_critical_delay,
           {round_mean('driver_delay_origin', 4)} AS driver_delay_origin,
           {round_mean('speed', 4)} AS speed,
           {round_mean('driver_consumer_evaluation', 4)} AS consumer_evaluation,
           {round_mean('is_ontime', 4)} AS sla
    FROM facts GROUP BY driver_uuid""", extra=[("facts", FACTS_SQL)]))
def delivery_kpis(spark, sf):
    return feat.delivery_kpis(_facts(spark, sf))


@register("on_time_share", with_views(["deliveries"], f"""
    SELECT driver_uuid, count(order_delivery_uuid) AS deliveries, {round_mean('is_ontime', 4)} AS sla
    FROM facts GROUP BY driver_uuid""", extra=[("facts", FACTS_SQL)]))
def on_time_share(spark, sf):
    return feat.on_time_share(_facts(spark, sf))


_REGION_COUNTS = ("counts", """
    SELECT driver_uuid, logistic_region, count(order_delivery_uuid) AS count_orders
    FROM facts GROUP BY driver_uuid, logistic_region""")


@register("main_region_ties", with_views(["deliveries"], """
    SELECT driver_uuid, logistic_region FROM (
        SELECT *, dense_rank() OVER (PARTITION BY driver_uuid ORDER BY count_orders DESC) AS rk FROM counts)
    WHERE rk = 1""", extra=[("facts", FACTS_SQL), _REGION_COUNTS]))
def main_region_ties(spark, sf):
    return feat.main_region(_facts(spark, sf), ties="all")


@register("main_region_single", with_views(["deliveries"], """
    SELECT driver_uuid, logistic_region FROM (
        SELECT *, row_number() OVER (PARTITION BY driver_uuid
                                     ORDER BY count_orders DESC, logistic_region ASC) AS rk FROM counts)
    WHERE rk = 1""", extra=[("facts", FACTS_SQL), _REGION_COUNTS]))
def main_region_single(spark, sf):
    return feat.main_region(_facts(spark, sf), ties="one")


# Supply per (driver, day) as SQL (K5/K6 share it). DuckDB dayofweek: Sunday = 0.
SUPPLY_DAILY_SQL = f"""
    SELECT driver_uuid, date_partition,
           sum(CASE WHEN ((hour(interval_start_timestamp) >= 11 AND hour(interval_start_timestamp) < 14)
                       OR (hour(interval_start_timestamp) >= 18 AND hour(interval_start_timestamp) < 20))
                      AND interval_executed_seconds > 0
                    THEN interval_executed_seconds / 3600 ELSE 0.0 END) AS critical_hours_executed,
           sum(CASE WHEN (dayofweek(interval_start_timestamp) + 1 = 6 AND hour(interval_start_timestamp) >= 18)
                      OR dayofweek(interval_start_timestamp) + 1 IN (7, 1)
                    THEN interval_executed_seconds / 3600 ELSE 0.0 END) AS hours_special,
           sum(interval_executed_seconds / 3600) AS hours_executed,
           sum(CASE WHEN interval_executed_seconds > 0 THEN interval_executed_seconds / 3600 END) AS positive_hours,
           count(CASE WHEN interval_executed_seconds > 0 THEN 1 END) AS positive_intervals
    FROM supply_intervals
    WHERE {EVENTS_15.sql('date_partition')}
    GROUP BY driver_uuid, date_partition"""

SUPPLY_MEANS_SQL = """
    SELECT driver_uuid, count(date_partition) AS days_connected,
           avg(critical_hours_executed) AS avg_daily_critical_hours_executed,
           avg(hours_special) AS avg_special_hours_executed,
           avg(hours_executed) AS avg_total_hours_executed
    FROM daily GROUP BY driver_uuid"""


@register("supply_daily_means", with_views(["supply_intervals"], SUPPLY_MEANS_SQL,
                                           extra=[("daily", SUPPLY_DAILY_SQL)]))
def supply_daily_means(spark, sf):
    t = fixtures(spark, sf)
    return feat.supply_means(_daily(t))


UTR_SQL = """
    SELECT h.driver_uuid, avg(o.deliveries / nullif(h.positive_hours, 0)) AS avg_daily_utr
    FROM (SELECT driver_uuid, date_partition, positive_hours FROM daily WHERE positive_intervals > 0) h
    LEFT JOIN (SELECT driver_uuid, date_partition, count(DISTINCT order_delivery_uuid) AS deliveries
               FROM facts GROUP BY driver_uuid, date_partition) o
      ON h.driver_uuid = o.driver_uuid AND h.date_partition = o.date_partition
    GROUP BY h.driver_uuid"""


@register("utr", with_views(["supply_intervals", "deliveries"], UTR_SQL,
                            extra=[("daily", SUPPLY_DAILY_SQL), ("facts", FACTS_SQL)]))
def utr(spark, sf):
    t = fixtures(spark, sf)
    return feat.utr(_daily(t), _facts(spark, sf))


@register("recharge_features", with_views(["billing"], f"""
    SELECT driver_uuid, count(DISTINCT id) AS qty_recharge, {round_mean('quantity', 4)} AS avg_recharge
    FROM billing
    WHERE {EVENTS_15.sql('day')} AND billing_cause IN ({_causes})
    GROUP BY driver_uuid"""))
def recharge_features(spark, sf):
    return feat.recharge_features(fixtures(spark, sf).billing(with_uuid=True), EVENTS_15, RECHARGE_CAUSES)


@register("wallet_non_negative_share", with_views(["wallet_streak", "workers"], f"""
    SELECT w.driver_uuid,
           count(DISTINCT CASE WHEN s.sign >= 0 THEN s.date_partition END)::DOUBLE
             / (date_diff('day', min(s.date_partition), max(s.date_partition)) + 1) AS share_days_non_negative
    FROM wallet_streak s LEFT JOIN workers w ON s.driver_id = w.driver_id
    WHERE {EVENTS_15.sql('s.date_partition')}
    GROUP BY w.driver_uuid"""))
def wallet_non_negative_share(spark, sf):
    t = fixtures(spark, sf)
    return feat.wallet_non_negative_share(t.wallet_streak(), t.workers(), EVENTS_15)
