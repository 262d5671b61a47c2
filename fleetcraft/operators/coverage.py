"""Order coverage reports.

The reference scans the order table five times (totals, per setting, per
region, per driver ...). Here one (driver, region) aggregate of the window is
built once and every report is derived from it, so the raw orders are
shuffled a single time and all joins see one row per driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcraft.functions.columns import ratio, round_mean
from fleetcraft.functions.joins import with_one_row
from fleetcraft.functions.period import Period
from fleetcraft.operators.features import CASH_PAYMENT, order_regions


def order_base(wallet_orders: DataFrame, period: Period | None, cash: str = CASH_PAYMENT) -> DataFrame:
    """Orders and cash orders per (driver, order region) in the window.

    The same aggregate feeds the worker row (R2): build it once and give it to both.
    """
    return order_regions(wallet_orders, period, cash)


def orders_per_driver(base: DataFrame) -> DataFrame:
    return base.groupBy("driver_id").agg(F.sum("orders").alias("orders"),
                                         F.sum("cash_orders").alias("cash_orders"))


def orders_per_region(base: DataFrame) -> DataFrame:
    """Denominators by the *order's* region."""
    return base.groupBy("logistic_region").agg(F.sum("orders").alias("total_orders"),
                                               F.sum("cash_orders").alias("total_cash_orders"))


def order_totals(base: DataFrame) -> DataFrame:
    return base.agg(F.sum("orders").alias("total_orders"), F.sum("cash_orders").alias("total_cash_orders"))


def order_coverage(base: DataFrame, rules: DataFrame, settings: Sequence[str] = ("setting_1", "final_setting"),
                   digits: int = 2) -> DataFrame:
    """Orders and cash orders of selected (1) and not selected (0) drivers
    per setting, with their share of all orders in the window.

    Drivers unknown to the rules count as not selected. The settings are
    unpivoted so all of them are aggregated in one pass (one shuffle).
    """
    per_driver = orders_per_driver(base)
    flags = rules.select("driver_id", *[F.col(s).cast("int").alias(s) for s in settings])
    joined = per_driver.join(flags, "driver_id", "left").na.fill(0, list(settings))
    long = joined.unpivot(["driver_id", "orders", "cash_orders"], list(settings), "setting", "selected")
    agg = (long.groupBy("setting", "selected")
           .agg(F.sum("orders").alias("orders"), F.sum("cash_orders").alias("cash_orders")))
    return (with_one_row(agg, order_totals(base))
            .select("selected", "orders", "cash_orders",
                    F.round(ratio("orders", "total_orders"), digits).alias("perc_orders"),
                    F.round(ratio("cash_orders", "total_cash_orders"), digits).alias("perc_cash_orders"),
                    "setting"))


def region_coverage(base: DataFrame, rules: DataFrame, setting: str, digits: int = 2) -> DataFrame:
    """Per region, drivers, share and number selected, and the share of
    the region's orders and cash orders taken by selected drivers.

    Numerators use the driver's region (earliest order), denominators the
    order's region, as in the reference: shares need not sum to 1.
    """
    per_driver = orders_per_driver(base)
    sel = rules.select("logistic_region", "driver_id", F.col(setting).alias("selected"))
    res = (sel.join(per_driver, "driver_id", "left")
           .groupBy("logistic_region")
           .agg(F.count("driver_id").alias("drivers"),
                round_mean("selected", digits).alias("perc_drivers"),
                F.sum("selected").alias("selected_drivers"),
                F.sum(F.col("orders") * F.col("selected")).alias("orders"),
                F.sum(F.col("cash_orders") * F.col("selected")).alias("cash_orders")))
    return (res.join(orders_per_region(base), "logistic_region")
            .orderBy(F.desc("orders"), "logistic_region")
            .select("logistic_region", "drivers", "perc_drivers", "selected_drivers",
                    F.round(ratio("orders", "total_orders"), digits).alias("perc_orders"),
                    F.round(ratio("cash_orders", "total_cash_orders"), digits).alias("perc_cash_orders")))


def region_settings(rules: DataFrame, regions: Sequence[str], label: str = "setting 1") -> DataFrame:
    """Distinct regions of the worker table with a setting label (NULL if not listed)."""
    return (rules.select("logistic_region").distinct()
            .withColumn("region_setting",
                        F.when(F.col("logistic_region").isin(list(regions)), F.lit(label))))


def region_coverage_labelled(base: DataFrame, rules: DataFrame, setting: str, regions: Sequence[str],
                             label: str = "setting 1") -> DataFrame:
    """R13 for the listed regions only, with the region's setting label."""
    return (region_coverage(base, rules, setting)
            .join(region_settings(rules, regions, label), "logistic_region", "left")
            .where(F.col("logistic_region").isin(list(regions))))


def rule_distribution(rules: DataFrame, digits: int = 2) -> DataFrame:
    """Drivers and share passing setting_1 / final, overall and by segment.

    One ``rollup``; ``is_total`` = 1 marks the overall row (its segment is NULL).
    """
    return (rules.rollup("segmentation_def")
            .agg(F.grouping("segmentation_def").cast("int").alias("is_total"),
                 F.count("driver_id").alias("drivers"),
                 round_mean("setting_1", digits).alias("setting_1_perc_drivers"),
                 round_mean("final_setting", digits).alias("perc_drivers_def")))
