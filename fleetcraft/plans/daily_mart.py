"""The feature row from stored days: each run reads only days it has not seen.

A store holds three tables partitioned by date, none with raw rows: deliveries
per (driver, region, day) as exact sums and counts, different deliveries per
(driver, day), and executed hours per (driver id, day). Sums and counts of days
add up to those of any window, so main region, delivery means, hours and
deliveries per hour of a window equal those of a full build. A ledger lists
the days that are complete.

A run writes the tables with dynamic partition overwrite and the ledger last: a
run that dies leaves days that are not in the ledger, and the next run replaces
them. Days of late data are named in ``again`` and replaced. One run at a time
may write to a store. A day without rows is in the ledger and in no table; a day
of ``again`` that has lost all its rows keeps the old ones.

Recharges, routes, strikes and the wallet share count different ids or days
over the whole window, which days do not add up to; they read their window.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcraft.functions.joins import fold_left
from fleetcraft.functions.period import Period
from fleetcraft.operators import features as feat
from fleetcraft.operators.features import EXACT, MEANS, driver_days, main_region_of_days, means_of_days, region_days
from fleetcraft.plans.feature_mart import FeatureParams, finish_row
from fleetcraft.sources.tables import materialise, write_partitioned

_REGION_DAYS = ("driver_uuid string, logistic_region string, n_deliveries long, "
                + ", ".join(f"sum_{m} {EXACT}, n_{m} long" for m in MEANS) + ", date_partition date")
_DRIVER_DAYS = "driver_uuid string, deliveries long, date_partition date"


@dataclass(frozen=True)
class DayStore:
    """Daily partial results under a shared folder."""

    spark: SparkSession
    path: str

    def _at(self, name: str) -> str:
        return os.path.join(self.path, name)

    def _read(self, name: str, schema: str, period: Period) -> DataFrame:
        """The days of a window; only their folders are read."""
        have = self.days()
        missing = [d for d in _days(period) if d not in have]
        if missing:
            raise ValueError(f"days not in the store: {', '.join(map(str, missing))}")
        return self.spark.read.schema(schema).parquet(self._at(name)).where(period.contains("date_partition"))

    def days(self) -> set[dt.date]:
        """The days in the ledger, a row per day."""
        try:
            ledger = self.spark.read.schema("day date").parquet(self._at("ledger"))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return set()
            raise
        return {r["day"] for r in ledger.distinct().collect()}

    def update(self, t, p: FeatureParams, again: Collection[dt.date] = ()) -> list[dt.date]:
        """Add the days of the windows that are not there yet, and those of ``again``; returns the days added."""
        if p.windows.deliveries is None or p.windows.deliveries != p.windows.supply:
            raise ValueError("deliveries and supply need one bounded window")
        have = self.days()
        new = sorted({d for d in _days(p.windows.deliveries) if d not in have} | set(again))
        if not new:
            return []
        wanted = F.col("date_partition").isin(new)
        facts = feat.delivery_facts(t.deliveries().where(wanted), None, p.codes)
        write_partitioned(region_days(facts), self._at("region_days"))
        write_partitioned(driver_days(facts), self._at("driver_days"))
        write_partitioned(feat.supply_daily(t.supply_intervals().where(wanted), None, "driver_id"), self._at("supply_days"))
        ledger = self.spark.createDataFrame([(d,) for d in new], "day date").coalesce(1)
        ledger.write.mode("append").parquet(self._at("ledger"))
        return new

    def region_days(self, period: Period) -> DataFrame:
        return self._read("region_days", _REGION_DAYS, period)

    def driver_days(self, period: Period) -> DataFrame:
        return self._read("driver_days", _DRIVER_DAYS, period)

    def supply_days(self, period: Period, driver_id_type: str) -> DataFrame:
        schema = (f"driver_id {driver_id_type}, critical_hours_executed double, hours_special double, hours_executed double, "
                  "positive_hours double, positive_intervals long, date_partition date")
        return self._read("supply_days", schema, period)


def _days(period: Period) -> list[dt.date]:
    return [period.start + dt.timedelta(days=k) for k in range((period.end - period.start).days + 1)]


def feature_row(t, p: FeatureParams, store: DayStore) -> DataFrame:
    """K9, K10 of a window whose days are all in the store (else an error): equal to the full build."""
    w = p.windows
    days = store.region_days(w.deliveries)
    id_type = t.supply_intervals().schema["driver_id"].dataType.simpleString()
    daily = feat.daily_by_uuid(store.supply_days(w.supply, id_type), t.workers())
    parts = [
        means_of_days(days),
        feat.route_completion_by_uuid(t.routes(), t.workers(), w.routes).select("driver_uuid", "prop_completed_routes"),
        feat.supply_means(daily),
        feat.strikes_history(t.strikes(), t.workers(), w.end, p.strike_excluded),
        feat.recharge_features_by_uuid(t.billing(), t.workers(), w.billing, p.recharge_causes),
        feat.wallet_non_negative_share(t.wallet_streak(), t.workers(), w.wallet),
        feat.utr_of_days(daily, store.driver_days(w.deliveries)),
    ]
    joined = fold_left(main_region_of_days(days, p.ties), parts, "driver_uuid")
    return finish_row(materialise(joined, "joined-features"), t, p)
