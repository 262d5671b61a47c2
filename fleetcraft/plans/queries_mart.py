"""Pipeline-level queries: feature row, worker row, rules, coverage, final
table, SQL checks, quality and geo (K9-K10, R8-R16, A18, S9, Q1-Q5, G1-G4)."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F


from fleetcraft.functions.period import Period
from fleetcraft.operators import coverage as cov
from fleetcraft.operators import eligibility as elig
from fleetcraft.operators import geo, quality
from fleetcraft.plans import daily_mart, feature_mart
from fleetcraft.plans.settings import (ELIGIBILITY, EVENTS_15, EVENTS_30, FEATURE_END, FEATURES, ORDERS_WINDOW,
                                        RECHARGE_CAUSES, REGIONS, RULES_ACTIVE, RULES_ALTERNATE, RUN_DATE,
                                        SENIORITY_AS_OF, STRIKE_EXCLUDED, CODES, NEW_DRIVER_AS_OF,
                                        fixtures, register)
from fleetcraft.plans.oracle_views import initcap, money_mean, money_sum, round_mean, with_views
from fleetcraft.plans.queries_driver import FACTS_SQL, SUPPLY_DAILY_SQL, UTR_SQL
from fleetcraft.sources import tables

_causes = ", ".join(f"'{c}'" for c in RECHARGE_CAUSES)
_excluded = ", ".join(f"'{c}'" for c in STRIKE_EXCLUDED)


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---------------------------------------------------------------------------
# Feature row
# ---------------------------------------------------------------------------

FEATURE_VIEWS = ["deliveries", "routes", "workers", "supply_intervals", "strikes", "billing", "wallet_streak",
                 "worker_registration"]

FEATURE_CTES = [
    ("facts", FACTS_SQL),
    ("region_counts", """
        SELECT driver_uuid, logistic_region, count(order_delivery_uuid) AS count_orders
        FROM facts GROUP BY driver_uuid, logistic_region"""),
    ("fbase", """
        SELECT driver_uuid, logistic_region FROM (
            SELECT *, row_number() OVER (PARTITION BY driver_uuid
                                         ORDER BY count_orders DESC, logistic_region ASC) AS rk
            FROM region_counts) WHERE rk = 1"""),
    ("kpis", f"""
        SELECT driver_uuid, {round_mean('is_critical_delay', 4)} AS prop_critical_delay,
               {round_mean('driver_delay_origin', 4)} AS driver_delay_origin,
               {round_mean('speed', 4)} AS speed,
               {round_mean('driver_consumer_evaluation', 4)} AS consumer_evaluation,
               {round_mean('is_ontime', 4)} AS sla
        FROM facts GROUP BY driver_uuid"""),
    ("froutes", f"""
        SELECT w.driver_uuid,
               sum(CASE WHEN coalesce(r.cancel_rejection_type, 'completed') = 'completed' THEN 1 ELSE 0 END)::DOUBLE
                 / nullif(count(*), 0) AS prop_completed_routes
        FROM routes r LEFT JOIN workers w ON r.driver_id = w.driver_id
        WHERE {EVENTS_30.sql('r.date_partition')} GROUP BY w.driver_uuid"""),
    ("daily", SUPPLY_DAILY_SQL),
    ("fsupply", """
        SELECT driver_uuid, count(date_partition) AS days_connected,
               avg(critical_hours_executed) AS avg_daily_critical_hours_executed,
               avg(hours_special) AS avg_special_hours_executed,
               avg(hours_executed) AS avg_total_hours_executed
        FROM daily GROUP BY driver_uuid"""),
    ("fstrikes", f"""
        SELECT w.driver_uuid, count(DISTINCT s.strike_id) AS strikes
        FROM strikes s LEFT JOIN workers w ON s.driver_id = w.driver_id
        WHERE s.created_date <= DATE '{FEATURE_END}' AND s.strike_classification NOT IN ({_excluded})
        GROUP BY w.driver_uuid"""),
    ("frecharge", f"""
        SELECT driver_uuid, count(DISTINCT id) AS qty_recharge, {round_mean('quantity', 4)} AS avg_recharge
        FROM billing WHERE {EVENTS_15.sql('day')} AND billing_cause IN ({_causes})
        GROUP BY driver_uuid"""),
    ("fwallet", f"""
        SELECT w.driver_uuid,
               count(DISTINCT CASE WHEN s.sign >= 0 THEN s.date_partition END)::DOUBLE
                 / (date_diff('day', min(s.date_partition), max(s.date_partition)) + 1) AS share_days_non_negative
        FROM wallet_streak s LEFT JOIN workers w ON s.driver_id = w.driver_id
        WHERE {EVENTS_15.sql('s.date_partition')}
        GROUP BY w.driver_uuid"""),
    ("futr", UTR_SQL),
    ("fjoined", """
        SELECT b.driver_uuid, b.logistic_region, k.prop_critical_delay, k.driver_delay_origin, k.speed,
               k.consumer_evaluation, k.sla, r.prop_completed_routes, s.days_connected,
               s.avg_daily_critical_hours_executed, s.avg_special_hours_executed, s.avg_total_hours_executed,
               coalesce(t.strikes, 0) AS strikes, coalesce(c.qty_recharge, 0) AS qty_recharge,
               coalesce(c.avg_recharge, 0.0) AS avg_recharge,
               coalesce(w.share_days_non_negative, 0.0) AS share_days_non_negative,
               coalesce(u.avg_daily_utr, 0.0) AS avg_daily_utr
        FROM fbase b
        LEFT JOIN kpis k ON b.driver_uuid = k.driver_uuid
        LEFT JOIN froutes r ON b.driver_uuid = r.driver_uuid
        LEFT JOIN fsupply s ON b.driver_uuid = s.driver_uuid
        LEFT JOIN fstrikes t ON b.driver_uuid = t.driver_uuid
        LEFT JOIN frecharge c ON b.driver_uuid = c.driver_uuid
        LEFT JOIN fwallet w ON b.driver_uuid = w.driver_uuid
        LEFT JOIN futr u ON b.driver_uuid = u.driver_uuid"""),
    ("fmeans", """
        SELECT avg(speed::DOUBLE) AS m_speed, avg(consumer_evaluation::DOUBLE) AS m_eval,
               avg(days_connected::DOUBLE) AS m_days, avg(avg_daily_critical_hours_executed::DOUBLE) AS m_crit
        FROM fjoined"""),
    ("ffilled", f"""
        SELECT driver_uuid, logistic_region, prop_critical_delay, driver_delay_origin,
               coalesce(speed::DOUBLE, m_speed) AS speed, coalesce(consumer_evaluation::DOUBLE, m_eval)
                   AS consumer_evaluation,
               sla, prop_completed_routes, coalesce(days_connected::DOUBLE, m_days) AS days_connected,
               coalesce(avg_daily_critical_hours_executed::DOUBLE, m_crit) AS avg_daily_critical_hours_executed,
               avg_special_hours_executed, avg_total_hours_executed, strikes, qty_recharge, avg_recharge,
               share_days_non_negative, avg_daily_utr, DATE '{FEATURE_END}' AS date_partition
        FROM fjoined CROSS JOIN fmeans"""),
    ("fnew", f"""
        SELECT y.driver_uuid, y.logistic_region, coalesce(o.orders, 0) AS orders, y.antiquity
        FROM (SELECT w.driver_uuid, {initcap('trim(r.logistic_region)')} AS logistic_region,
                     CAST(date_diff('day', CAST(r.registration_approval_timestamp AS DATE),
                                    DATE '{NEW_DRIVER_AS_OF}') AS INTEGER) AS antiquity
              FROM worker_registration r LEFT JOIN workers w ON w.driver_id = r.worker_id
              WHERE r.worker_state = 'ACTIVE') y
        LEFT JOIN (SELECT driver_uuid, count(DISTINCT order_uuid) AS orders FROM deliveries
                   WHERE date_partition <= DATE '{NEW_DRIVER_AS_OF}' GROUP BY driver_uuid) o
          ON y.driver_uuid = o.driver_uuid
        WHERE y.antiquity <= 30 AND coalesce(o.orders, 0) <= 5"""),
]

_REGION_LABELS = ", ".join(f"'{r.capitalize()}'" for r in REGIONS)

FEATURE_ROW_SQL = f"""
    SELECT f.*, n.orders, n.antiquity
    FROM (SELECT * FROM ffilled WHERE COLUMNS(*) IS NOT NULL) f
    LEFT JOIN fnew n ON f.driver_uuid = n.driver_uuid AND f.logistic_region = n.logistic_region
    WHERE f.logistic_region IN ({_REGION_LABELS})"""


def feature_sql(body: str, extra: list[tuple[str, str]] = ()) -> str:
    """An oracle over the ``features`` table (the feature row) as a CTE."""
    return with_views(FEATURE_VIEWS, body, extra=FEATURE_CTES + [("features", FEATURE_ROW_SQL)] + list(extra))


@register("feature_row", with_views(FEATURE_VIEWS, FEATURE_ROW_SQL, extra=FEATURE_CTES))
def feature_row(spark, sf):
    return feature_mart.feature_row(fixtures(spark, sf), FEATURES)


@register("feature_row_incremental", with_views(FEATURE_VIEWS, FEATURE_ROW_SQL, extra=FEATURE_CTES))
def feature_row_incremental(spark, sf):
    """The feature row from stored days: an earlier run's window, then only the days it lacked."""
    from fleetcraft.sources.tables import scratch_path
    t, store = fixtures(spark, sf), daily_mart.DayStore(spark, scratch_path(spark, "day-store"))
    earlier = Period.before(FEATURE_END, 15)
    store.update(t, replace(FEATURES, windows=replace(FEATURES.windows, deliveries=earlier, supply=earlier)))
    store.update(t, FEATURES)
    return daily_mart.feature_row(t, FEATURES, store)


def features_table(spark, sf):
    """The feature row as a stored table, for consumers that make several passes."""
    from fleetcraft.sources.tables import materialise
    return materialise(feature_mart.feature_row(fixtures(spark, sf), FEATURES), "features")


# ---------------------------------------------------------------------------
# Worker row and rules
# ---------------------------------------------------------------------------

WORKER_VIEWS = ["wallet_orders", "accounts", "segmentation", "daily_wallet", "strikes", "deliveries", "billing",
                "supply_intervals", "routes"]

WORKER_CTES = [
    ("wbase", f"""
        SELECT driver_id,
               avg(CASE WHEN wallet_before_order < 0 THEN 1 ELSE 0 END) AS perc_negative_orders,
               avg(CASE WHEN payment_type = 'MONEY' THEN 1 ELSE 0 END) AS perc_cash_orders,
               count(order_number) AS orders,
               arg_min(logistic_region, (date_timestamp, order_number)) AS logistic_region
        FROM wallet_orders WHERE {ORDERS_WINDOW.sql('date_partition')} GROUP BY driver_id"""),
    ("wacc", """
        SELECT driver_id, min(driver_uuid) AS driver_uuid FROM accounts
        WHERE tenant = 'co' AND driver_id IS NOT NULL GROUP BY driver_id"""),
    ("wseg", """
        SELECT driver_id, arg_max(segment, (segmentation_date, segment)) AS segmentation_def,
               arg_max(logistic_region, (segmentation_date, segment)) AS segment_region
        FROM segmentation GROUP BY driver_id"""),
    ("wwal", f"""
        SELECT driver_id, CAST(sum(CASE WHEN wallet < 0 THEN 1 ELSE 0 END) AS BIGINT) AS days_negative,
               {money_mean('wallet')} AS avg_wallet, min(wallet) AS min_wallet
        FROM daily_wallet WHERE {EVENTS_30.sql('date_data - 1')} GROUP BY driver_id"""),
    ("wstk", f"""
        SELECT driver_id, count(DISTINCT strike_id) AS strikes FROM strikes
        WHERE {EVENTS_15.sql('created_date')} AND strike_classification NOT IN ({_excluded})
        GROUP BY driver_id"""),
    ("wsen", f"""
        SELECT driver_id, min(date_partition) AS first_order,
               CAST(date_diff('day', min(date_partition), DATE '{SENIORITY_AS_OF}') AS INTEGER) AS seniority_days
        FROM deliveries WHERE last_status = '{CODES.completed}' AND date_partition <= DATE '{SENIORITY_AS_OF}'
        GROUP BY driver_id"""),
    ("wrch", f"""
        SELECT driver_id, count(id) AS recharges, {money_mean('quantity / 100.0')} AS avg_recharge,
               count(DISTINCT day) AS days_with_recharges, {money_sum('quantity / 100.0')} AS total_recharges
        FROM billing WHERE {EVENTS_30.sql('day')} AND billing_cause IN ({_causes}) GROUP BY driver_id"""),
    ("wonl", f"""
        SELECT driver_id, sum(interval_executed_seconds / 3600) AS online_hours,
               sum(interval_worked_seconds / 3600) AS working_hours
        FROM supply_intervals WHERE {EVENTS_30.sql('date_partition')} GROUP BY driver_id"""),
    ("wrte", f"""
        SELECT driver_id,
               sum(CASE WHEN coalesce(cancel_rejection_type, 'completed') = 'completed' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0)
                   AS prop_completed_routes,
               1.0 - sum(CASE WHEN coalesce(cancel_rejection_type, 'completed') = 'completed' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0)
                   AS prop_declined_orders
        FROM routes WHERE {EVENTS_30.sql('date_partition')} GROUP BY driver_id"""),
    ("workers_row", """
        SELECT b.driver_id, b.perc_negative_orders, b.perc_cash_orders, b.orders, b.logistic_region,
               a.driver_uuid, g.segmentation_def, w.days_negative, w.avg_wallet, w.min_wallet,
               coalesce(s.strikes, 0) AS strikes, n.first_order, coalesce(n.seniority_days, 0) AS seniority_days,
               coalesce(r.recharges, 0) AS recharges, r.avg_recharge,
               coalesce(r.days_with_recharges, 0) AS days_with_recharges,
               coalesce(r.total_recharges, 0.0) AS total_recharges, o.online_hours, o.working_hours,
               t.prop_completed_routes, t.prop_declined_orders
        FROM wbase b
        LEFT JOIN wacc a ON b.driver_id = a.driver_id
        LEFT JOIN wseg g ON b.driver_id = g.driver_id
        LEFT JOIN wwal w ON b.driver_id = w.driver_id
        LEFT JOIN wstk s ON b.driver_id = s.driver_id
        LEFT JOIN wsen n ON b.driver_id = n.driver_id
        LEFT JOIN wrch r ON b.driver_id = r.driver_id
        LEFT JOIN wonl o ON b.driver_id = o.driver_id
        LEFT JOIN wrte t ON b.driver_id = t.driver_id"""),
]


def rules_sql(rule_set) -> str:
    """SELECT over ``workers_row`` adding rule, setting and final flags."""
    rules = []
    for r in rule_set.rules:
        cond = f"{r.column} IN ({_in(r.value)})" if r.op == "in" else f"{r.column} {'=' if r.op == '==' else r.op} {r.value}"
        rules.append(f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {r.name}")
    settings = [f"CASE WHEN {' + '.join(m)} = {len(m)} THEN 1 ELSE 0 END AS {name}"
                for name, m in rule_set.settings.items()]
    final = " OR ".join(f"(logistic_region IN ({_in(regs)}) AND {s} = 1)" for regs, s in rule_set.final)
    return f"""
        SELECT *, CASE WHEN {final} THEN 1 ELSE 0 END AS final_setting FROM (
            SELECT *, {', '.join(settings)} FROM (
                SELECT *, {', '.join(rules)} FROM workers_row))"""


RULES_CTES = WORKER_CTES + [("rules", rules_sql(RULES_ACTIVE))]


def worker_sql(body: str, extra: list[tuple[str, str]] = ()) -> str:
    return with_views(WORKER_VIEWS, body, extra=RULES_CTES + list(extra))


def _rules(spark, sf, rule_set=RULES_ACTIVE):
    return elig.apply_rules(elig.worker_row(fixtures(spark, sf), ELIGIBILITY), rule_set)


@register("worker_row", worker_sql("SELECT * FROM workers_row"))
def worker_row(spark, sf):
    return elig.worker_row(fixtures(spark, sf), ELIGIBILITY)


@register("rules_active", worker_sql("SELECT * FROM rules"))
def rules_active(spark, sf):
    return _rules(spark, sf)


@register("rules_alternate", with_views(WORKER_VIEWS, rules_sql(RULES_ALTERNATE), extra=WORKER_CTES))
def rules_alternate(spark, sf):
    return _rules(spark, sf, RULES_ALTERNATE)


# ---------------------------------------------------------------------------
# Coverage (R12-R14, A18)
# ---------------------------------------------------------------------------

ORDER_CTES = [
    ("wo", f"""
        SELECT driver_id, logistic_region, CASE WHEN payment_type = 'MONEY' THEN 1 ELSE 0 END AS cash
        , order_number FROM wallet_orders WHERE {ORDERS_WINDOW.sql('date_partition')}"""),
    ("odrv", """
        SELECT driver_id, count(order_number) AS orders, CAST(sum(cash) AS BIGINT) AS cash_orders
        FROM wo GROUP BY driver_id"""),
    ("oreg", """
        SELECT logistic_region, count(order_number) AS total_orders, CAST(sum(cash) AS BIGINT) AS total_cash_orders
        FROM wo GROUP BY logistic_region"""),
]


def _base_and_rules(spark, sf):
    """The order aggregate, stored once, and the rules over the worker row made of it."""
    t = fixtures(spark, sf)
    base = tables.materialise(cov.order_base(t.wallet_orders(), ORDERS_WINDOW), "order-base")
    return base, elig.apply_rules(elig.worker_row(t, ELIGIBILITY, base), RULES_ACTIVE)


@register("order_coverage", worker_sql("""
    SELECT x.selected, x.orders, x.cash_orders,
           round(x.orders / nullif(t.total_orders, 0)::DOUBLE, 2) AS perc_orders,
           round(x.cash_orders / nullif(t.total_cash_orders, 0)::DOUBLE, 2) AS perc_cash_orders, x.setting
    FROM (
        SELECT setting, selected, sum(orders)::BIGINT AS orders, sum(cash_orders)::BIGINT AS cash_orders FROM (
            SELECT 'setting_1' AS setting, coalesce(r.setting_1, 0) AS selected, o.orders, o.cash_orders
            FROM odrv o LEFT JOIN rules r ON o.driver_id = r.driver_id
            UNION ALL
            SELECT 'final_setting', coalesce(r.final_setting, 0), o.orders, o.cash_orders
            FROM odrv o LEFT JOIN rules r ON o.driver_id = r.driver_id)
        GROUP BY setting, selected) x
    CROSS JOIN (SELECT sum(orders)::BIGINT AS total_orders, sum(cash_orders)::BIGINT AS total_cash_orders
                FROM odrv) t""", extra=ORDER_CTES))
def order_coverage(spark, sf):
    return cov.order_coverage(*_base_and_rules(spark, sf))


def _region_coverage_sql(setting: str) -> str:
    return f"""
        SELECT x.logistic_region, x.drivers, x.perc_drivers, x.selected_drivers,
               round(x.orders / nullif(g.total_orders, 0)::DOUBLE, 2) AS perc_orders,
               round(x.cash_orders / nullif(g.total_cash_orders, 0)::DOUBLE, 2) AS perc_cash_orders
        FROM (SELECT r.logistic_region, count(r.driver_id) AS drivers,
                     {round_mean(f'r.{setting}', 2)} AS perc_drivers,
                     CAST(sum(r.{setting}) AS BIGINT) AS selected_drivers,
                     CAST(sum(o.orders * r.{setting}) AS BIGINT) AS orders,
                     CAST(sum(o.cash_orders * r.{setting}) AS BIGINT) AS cash_orders
              FROM rules r LEFT JOIN odrv o ON r.driver_id = o.driver_id
              GROUP BY r.logistic_region) x
        JOIN oreg g ON x.logistic_region = g.logistic_region"""


@register("region_coverage", worker_sql(_region_coverage_sql("setting_1"), extra=ORDER_CTES))
def region_coverage(spark, sf):
    return cov.region_coverage(*_base_and_rules(spark, sf), "setting_1")


@register("region_coverage_labelled", worker_sql(f"""
    SELECT c.*, s.region_setting FROM ({_region_coverage_sql('final_setting')}) c
    LEFT JOIN (SELECT DISTINCT logistic_region,
                      CASE WHEN logistic_region IN ({_in(REGIONS)}) THEN 'setting 1' END AS region_setting
               FROM rules) s ON c.logistic_region = s.logistic_region
    WHERE c.logistic_region IN ({_in(REGIONS)})""", extra=ORDER_CTES))
def region_coverage_labelled(spark, sf):
    return cov.region_coverage_labelled(*_base_and_rules(spark, sf), "final_setting", REGIONS)


@register("rule_distribution", worker_sql(f"""
    SELECT segmentation_def, CAST(grouping(segmentation_def) AS INTEGER) AS is_total,
           count(driver_id) AS drivers, {round_mean('setting_1', 2)} AS setting_1_perc_drivers,
           {round_mean('final_setting', 2)} AS perc_drivers_def
    FROM rules GROUP BY ROLLUP (segmentation_def)"""))
def rule_distribution(spark, sf):
    return cov.rule_distribution(_rules(spark, sf))


# ---------------------------------------------------------------------------
# Final table, selected totals and the SQL checks
# ---------------------------------------------------------------------------

FINAL_CTE = ("final", f"""
    SELECT g.driver_id, g.segment_region AS logistic_region, DATE '{RUN_DATE}' AS date, g.segmentation_def,
           r.final_setting AS selected,
           g.segmentation_def || CASE WHEN r.final_setting = 1 THEN 'Prueba' ELSE '' END AS segment_nb
    FROM wseg g LEFT JOIN rules r ON g.driver_id = r.driver_id""")


def _final(spark, sf):
    return elig.final_segments(fixtures(spark, sf).segmentation(), _rules(spark, sf), RUN_DATE)


@register("final_segments", worker_sql("SELECT * FROM final", extra=[FINAL_CTE]))
def final_segments(spark, sf):
    return _final(spark, sf)


_RUNS = (dt.date(2024, 1, 1), dt.date(2024, 1, 10), RUN_DATE, dt.date(2024, 2, 15))
_HISTORY_SQL = """
    SELECT driver_id, segment, TIMESTAMP '2024-01-05 00:00:00' AS segmentation_date FROM segmentation
    UNION ALL SELECT driver_id, 'Bad', TIMESTAMP '2024-01-15 00:00:00' FROM segmentation WHERE driver_id % 3 = 0
    UNION ALL SELECT driver_id, 'Engaged', TIMESTAMP '2024-02-10 00:00:00' FROM segmentation WHERE driver_id % 5 = 0"""


@register("segments_as_of", with_views(["segmentation"], f"""
    SELECT r.run_date, h.driver_id, arg_max(h.segment, (h.segmentation_date, h.segment)) AS segmentation_def,
           max(h.segmentation_date) AS segmentation_date
    FROM history h JOIN (VALUES {', '.join(f"(DATE '{d}')" for d in _RUNS)}) r(run_date)
    ON CAST(h.segmentation_date AS DATE) <= r.run_date GROUP BY r.run_date, h.driver_id""", extra=[("history", _HISTORY_SQL)]))
def segments_as_of(spark, sf):
    """A history of three dates, one after the run, as several runs saw it."""
    now = fixtures(spark, sf).segmentation()
    dated = [("2024-01-05", F.col("segment"), F.lit(True)), ("2024-01-15", F.lit("Bad"), F.col("driver_id") % 3 == 0),
             ("2024-02-10", F.lit("Engaged"), F.col("driver_id") % 5 == 0)]
    history = None
    for day, segment, there in dated:
        part = now.where(there).select("driver_id", segment.alias("segment"), "logistic_region",
                                       F.lit(day).cast("timestamp_ntz").alias("segmentation_date"))
        history = part if history is None else history.unionByName(part)
    return elig.segments_as_of(history, _RUNS)


@register("selected_by_region", worker_sql("""
    SELECT logistic_region, CAST(sum(selected) AS BIGINT) AS selected_drivers FROM final
    WHERE selected = 1 GROUP BY logistic_region""", extra=[FINAL_CTE]))
def selected_by_region(spark, sf):
    return elig.selected_by_region(_final(spark, sf))


@register("selected_listing", worker_sql("SELECT * FROM final WHERE selected = 1", extra=[FINAL_CTE]))
def selected_listing(spark, sf):
    return elig.selected_listing(_final(spark, sf))


@register("selected_total", worker_sql("SELECT CAST(sum(selected) AS BIGINT) AS selected_drivers FROM final",
                                       extra=[FINAL_CTE]))
def selected_total(spark, sf):
    return elig.selected_total(_final(spark, sf))


def _final_view(spark, sf):
    """Publish the final table as the reference does, then expose it to SQL.

    Stage it (S4), stop on a duplicate driver (Q1 gate), overwrite the saved
    table (S5) and register the saved files as a view for the SQL checks (S9).
    """
    staged = tables.materialise(_final(spark, sf), "final-staged")
    quality.gate(quality.quality_report(staged, "driver_segments_final", unique_key="driver_id"))
    path = tables.scratch_path(spark, "driver-segments-final")
    tables.overwrite_table(staged, path)
    tables.register_views(spark, {"driver_segments_final": spark.read.parquet(path)})
    return spark


@register("sql_selected", worker_sql("SELECT * FROM final WHERE selected = 1", extra=[FINAL_CTE]))
def sql_selected(spark, sf):
    return _final_view(spark, sf).sql("SELECT * FROM driver_segments_final WHERE selected == 1")


@register("sql_dates", worker_sql("SELECT date FROM final GROUP BY 1", extra=[FINAL_CTE]))
def sql_dates(spark, sf):
    return _final_view(spark, sf).sql("SELECT date FROM driver_segments_final GROUP BY 1")


@register("sql_by_date", worker_sql(f"SELECT * FROM final WHERE date = DATE '{RUN_DATE}'", extra=[FINAL_CTE]))
def sql_by_date(spark, sf):
    return _final_view(spark, sf).sql(f"SELECT * FROM driver_segments_final WHERE date = DATE '{RUN_DATE}'")


# ---------------------------------------------------------------------------
# Quality (Q1-Q5)
# ---------------------------------------------------------------------------

QUALITY_NEVER_NULL = ("driver_uuid", "logistic_region", "prop_critical_delay", "sla", "prop_completed_routes",
                      "days_connected", "avg_total_hours_executed")


@register("quality_report", worker_sql(f"""
    SELECT 'has_unique_key' AS "check", 'driver_id' AS "column",
           count(DISTINCT driver_id) = count(*) AS passed, count(*) - count(DISTINCT driver_id) AS observed,
           'CRITICAL' AS level, 'driver_segments_final' AS dataset
    FROM final""", extra=[FINAL_CTE]))
def quality_report(spark, sf):
    return quality.quality_report(_final(spark, sf), "driver_segments_final", unique_key="driver_id")


@register("quality_features", feature_sql("\nUNION ALL\n".join(
    [f"""SELECT 'is_never_null' AS "check", '{c}' AS "column", count_if({c} IS NULL) = 0 AS passed,
               CAST(count_if({c} IS NULL) AS BIGINT) AS observed, 'CRITICAL' AS level, 'features' AS dataset
        FROM features"""
     for c in QUALITY_NEVER_NULL]
    + ["""SELECT 'has_num_rows_greater_than', NULL, count(*) > 1000, count(*), 'CRITICAL', 'features'
          FROM features"""])))
def quality_features(spark, sf):
    return quality.quality_report(features_table(spark, sf), "features", never_null=QUALITY_NEVER_NULL,
                                  min_rows=1000)


@register("duplicate_keys", with_views(["deliveries"], """
    SELECT driver_uuid, count(*) AS count FROM (
        SELECT driver_uuid, logistic_region FROM (
            SELECT *, dense_rank() OVER (PARTITION BY driver_uuid ORDER BY count_orders DESC) AS rk
            FROM region_counts) WHERE rk = 1)
    GROUP BY driver_uuid HAVING count(*) > 1""", extra=FEATURE_CTES[:2]))
def duplicate_keys(spark, sf):
    from fleetcraft.operators import features as feat
    ties = feat.main_region(feat.delivery_facts(fixtures(spark, sf).deliveries(), EVENTS_15, CODES), ties="all")
    return quality.duplicate_keys(ties, "driver_uuid")


# ---------------------------------------------------------------------------
# Geo repair
# ---------------------------------------------------------------------------

_BOX = geo.COLOMBIA
_LAT = f"BETWEEN {_BOX.lat[0]} AND {_BOX.lat[1]}"
_LON = f"BETWEEN {_BOX.lon[0]} AND {_BOX.lon[1]}"
GEO_CTE = ("repaired", f"""
    SELECT id, latitud, longitud,
           CASE WHEN latitud {_LAT} AND longitud {_LON} THEN latitud
                WHEN latitud {_LON} AND longitud {_LAT} THEN longitud
                WHEN latitud {_LAT} AND -longitud {_LON} THEN latitud
                WHEN -latitud {_LON} AND longitud {_LAT} THEN longitud END AS lat,
           CASE WHEN latitud {_LAT} AND longitud {_LON} THEN longitud
                WHEN latitud {_LON} AND longitud {_LAT} THEN latitud
                WHEN latitud {_LAT} AND -longitud {_LON} THEN -longitud
                WHEN -latitud {_LON} AND longitud {_LAT} THEN -latitud END AS lon,
           CASE WHEN latitud {_LAT} AND longitud {_LON} THEN 'inside'
                WHEN latitud {_LON} AND longitud {_LAT} THEN 'swapped'
                WHEN latitud {_LAT} AND -longitud {_LON} THEN 'lon_sign'
                WHEN -latitud {_LON} AND longitud {_LAT} THEN 'swapped_lon_sign'
                ELSE 'invalid' END AS repair
    FROM coordinates""")


@register("geo_repair", with_views(["coordinates"], "SELECT * FROM repaired", extra=[GEO_CTE]))
def geo_repair(spark, sf):
    return geo.repair_table(fixtures(spark, sf).coordinates())


@register("geo_repair_counts", with_views(["coordinates"],
                                          "SELECT repair, count(*) AS rows FROM repaired GROUP BY repair",
                                          extra=[GEO_CTE]))
def geo_repair_counts(spark, sf):
    return geo.repair_counts(geo.repair_table(fixtures(spark, sf).coordinates()))
