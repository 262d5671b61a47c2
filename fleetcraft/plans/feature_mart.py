"""The 15-day driver feature row (K9, K10) composed from the feature operators.

Plan shape: every source is reduced to one row per driver (or driver-day)
before any join; the fold of left joins then only moves per-driver rows. The
supply table feeds the daily means and UTR; deliveries are reduced to sums per
(driver, region) and to counts per (driver, day), and never written.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcraft.functions.columns import region_name, zero_fill
from fleetcraft.functions.joins import fold_left
from fleetcraft.functions.period import Period
from fleetcraft.operators import features as feat
from fleetcraft.operators.eligibility import CITIES_S1
from fleetcraft.operators.prepare import fill_with_mean
from fleetcraft.sources.tables import materialise

ZERO_FILLED = ("strikes", "qty_recharge", "avg_recharge", "avg_daily_utr", "share_days_non_negative")
MEAN_FILLED = ("speed", "consumer_evaluation", "days_connected", "avg_daily_critical_hours_executed")


@dataclass(frozen=True)
class FeatureWindows:
    """Per-source windows; ``uniform`` gives the reference's single 15-day window."""

    deliveries: Period | None
    routes: Period | None
    supply: Period | None
    billing: Period | None
    wallet: Period | None
    end: dt.date

    @classmethod
    def uniform(cls, end: dt.date, days: int = 15) -> FeatureWindows:
        p = Period.ending(end, days)
        return cls(p, p, p, p, p, p.end)


@dataclass(frozen=True)
class FeatureParams:
    windows: FeatureWindows
    new_driver_as_of: dt.date
    regions: Sequence[str] = CITIES_S1
    recharge_causes: Sequence[str] = feat.RECHARGE_CAUSES
    strike_excluded: Sequence[str] = feat.STRIKE_EXCLUDED_HISTORY
    codes: feat.DeliveryCodes = field(default_factory=feat.DeliveryCodes)
    ties: str = "one"
    new_driver_max_age: int = 30
    new_driver_max_orders: int = 5


def joined_features(t, p: FeatureParams, store: bool = False) -> DataFrame:
    """K9 before filling: main region + KPIs, routes, supply, strikes,
    recharges, wallet share and UTR, one row per (driver, main region).

    Region and KPIs come from sums per (driver, region), UTR from different
    deliveries per (driver, day) of drivers with hours: two pruned scans that
    aggregate map-side, so no delivery is ever written. With ``store`` the hours
    per (driver, day), which are read three times, are a table.
    """
    w = p.windows
    facts = feat.delivery_facts(t.deliveries(), w.deliveries, p.codes)
    daily = feat.daily_by_uuid(feat.supply_daily(t.supply_intervals(), w.supply, "driver_id"), t.workers())
    if store:
        daily = materialise(daily, "supply-days")
    base = feat.region_and_means(feat.region_sums(facts), p.ties)
    parts = [
        feat.route_completion_by_uuid(t.routes(), t.workers(), w.routes).select(
            "driver_uuid", "prop_completed_routes"),
        feat.supply_means(daily),
        feat.strikes_history(t.strikes(), t.workers(), w.end, p.strike_excluded),
        feat.recharge_features_by_uuid(t.billing(), t.workers(), w.billing, p.recharge_causes),
        feat.wallet_non_negative_share(t.wallet_streak(), t.workers(), w.wallet),
        feat.utr(daily, feat.of_drivers_with_hours(facts, daily)),
    ]
    return fold_left(base, parts, "driver_uuid")


def feature_row(t, p: FeatureParams, store: bool = True) -> DataFrame:
    """K9 + K10: filled feature row, new-driver attributes, listed regions only.

    Zero-fill five columns, fill four with their mean over all drivers (D6:
    the mean is a one-row aggregate broadcast back), stamp the run date, drop
    rows still holding a NULL, attach new-driver attributes on (uuid, region).

    The mean needs a pass over the joined rows before they can be filled; with
    ``store`` the joined per-driver table is written once to the shared
    checkpoint folder so the heavy scans and joins run a single time.
    """
    joined = joined_features(t, p, store)
    if store:
        joined = materialise(joined, "joined-features")
    return finish_row(joined, t, p)


def finish_row(joined: DataFrame, t, p: FeatureParams) -> DataFrame:
    """The joined features filled, stamped and with new-driver attributes."""
    row = zero_fill(joined, ZERO_FILLED)
    row = fill_with_mean(row, MEAN_FILLED)
    row = row.withColumn("date_partition", F.lit(p.windows.end)).na.drop()
    row = row.where(F.col("logistic_region").isin(*[region_name(F.lit(r)) for r in p.regions]))
    newd = feat.new_drivers(t.worker_registration(), t.workers(), t.deliveries(), p.new_driver_as_of,
                            p.new_driver_max_age, p.new_driver_max_orders, among=row)
    return row.join(newd, ["driver_uuid", "logistic_region"], "left")
