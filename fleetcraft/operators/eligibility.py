"""Worker row, rule engine and final selection table.

Rules are data: a rule is (name, column, operator, value) and a setting is the
set of rules that must all pass. The whole evaluation is one projection over
the one-row-per-driver worker table (no shuffle).
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcraft.functions.columns import flag, zero_fill
from fleetcraft.functions.joins import fold_left
from fleetcraft.functions.period import Period
from fleetcraft.operators import features as feat

_OPS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt,
        "==": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    op: str
    value: Any

    def expr(self) -> Column:
        c = F.col(self.column)
        if self.op == "in":
            return c.isin(list(self.value))
        return _OPS[self.op](c, F.lit(self.value))


@dataclass(frozen=True)
class RuleSet:
    """Rules, settings (all listed rules pass) and the final choice.

    ``final`` is a list of (regions, setting): a driver is finally selected when
    its region is in one of the lists and the paired setting holds.
    """

    rules: tuple[Rule, ...]
    settings: Mapping[str, tuple[str, ...]]
    final: tuple[tuple[tuple[str, ...], str], ...]


# Fixed values of the reference: region lists and both rule sets.
CITIES_S1 = ("BOGOTA", "CALI", "BARRANQUILLA", "MEDELLIN", "SANTA MARTA", "VALLEDUPAR", "MONTERIA",
             "PALMIRA", "MANIZALES", "SOLEDAD")
CITIES_S2 = ("BOGOTA", "CALI", "BARRANQUILLA", "SANTA MARTA", "VALLEDUPAR", "MONTERIA", "PALMIRA",
             "MANIZALES", "SOLEDAD")
ENGAGED_SEGMENTS = ("Engaged", "Performer", "Bad", "Canceler")

ACTIVE_RULES = RuleSet(
    rules=(Rule("rule_1", "avg_wallet", ">=", 0), Rule("rule_2", "strikes", "==", 0),
           Rule("rule_3", "seniority_days", ">", 30), Rule("rule_5", "avg_recharge", ">=", 15000),
           Rule("rule_6", "prop_declined_orders", "<=", 0.3), Rule("rule_9", "orders", ">=", 20),
           Rule("rule_10", "orders", ">=", 15)),
    settings={"setting_1": ("rule_1", "rule_2", "rule_3", "rule_5", "rule_6", "rule_10")},
    final=((CITIES_S1, "setting_1"),),
)

ALTERNATE_RULES = RuleSet(
    rules=(Rule("rule_1", "avg_wallet", ">=", 0), Rule("rule_2", "strikes", "==", 0),
           Rule("rule_3", "seniority_days", ">", 30), Rule("rule_4", "segmentation_def", "in", ENGAGED_SEGMENTS),
           Rule("rule_5", "avg_recharge", ">=", 30000), Rule("rule_6", "prop_declined_orders", "<=", 0.2),
           Rule("rule_7", "online_hours", ">=", 30), Rule("rule_8", "online_hours", ">=", 10),
           Rule("rule_9", "orders", ">=", 30), Rule("rule_10", "orders", ">=", 15)),
    settings={"setting_1": ("rule_1", "rule_2", "rule_3", "rule_5", "rule_6", "rule_7", "rule_9"),
              "setting_2": ("rule_1", "rule_2", "rule_3", "rule_5", "rule_6", "rule_8", "rule_10")},
    final=((CITIES_S1, "setting_1"), (CITIES_S2, "setting_2")),
)


@dataclass(frozen=True)
class EligibilityWindows:
    """Window per source. The reference uses one 30-day window for all of them;
    they are separate here so each source can be windowed on its own calendar."""

    orders: Period | None
    billing: Period | None
    wallet: Period | None
    strikes: Period | None
    supply: Period | None
    routes: Period | None
    as_of: dt.date

    @classmethod
    def uniform(cls, as_of: dt.date, days: int = 30) -> EligibilityWindows:
        p = Period.before(as_of, days)
        return cls(p, p, p, p, p, p, as_of)


@dataclass(frozen=True)
class EligibilityParams:
    windows: EligibilityWindows
    recharge_causes: Sequence[str] = feat.RECHARGE_CAUSES
    strike_excluded: Sequence[str] = feat.STRIKE_EXCLUDED_WINDOWED
    codes: feat.DeliveryCodes = field(default_factory=feat.DeliveryCodes)
    tenant: str = "co"


ZERO_FILLED = ("strikes", "seniority_days", "recharges", "days_with_recharges", "total_recharges")


def latest_segment(segmentation: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One segment per driver: the most recent ``segmentation_date`` (B13), no later than the day ``as_of`` if given.

    The latest date per driver is a hash aggregate of the raw rows; only the
    rows of that date meet the choice among equals (the greatest name).
    """
    rows = segmentation if as_of is None else segmentation.where(F.to_date("segmentation_date") <= F.lit(as_of))
    last = rows.groupBy("driver_id").agg(F.max("segmentation_date").alias("segmentation_date"))
    place = F.struct("segment", "logistic_region")
    return (rows.join(last, ["driver_id", "segmentation_date"]).groupBy("driver_id")
            .agg(F.max_by("segment", place).alias("segmentation_def"), F.max_by("logistic_region", place).alias("segment_region"),
                 F.max("segmentation_date").alias("segmentation_date")))


def segments_as_of(segmentation: DataFrame, run_dates: Sequence[dt.date]) -> DataFrame:
    """R15 for several runs: per run date and driver the segment that was the latest on that day.

    A row goes to each run that may see it, a bounded few; the latest date per
    run and driver is a hash aggregate, so no history is sorted. A driver without
    a segment by that day has no row.
    """
    runs = F.filter(F.array(*[F.lit(d) for d in run_dates]), lambda d: d >= F.to_date("segmentation_date"))
    seen = segmentation.select("driver_id", "segmentation_date", "segment", "logistic_region", F.explode(runs).alias("run_date"))
    last = seen.groupBy("run_date", "driver_id").agg(F.max("segmentation_date").alias("segmentation_date"))
    place = F.struct("segment", "logistic_region")
    return (seen.join(last, ["run_date", "driver_id", "segmentation_date"]).groupBy("run_date", "driver_id")
            .agg(F.max_by("segment", place).alias("segmentation_def"), F.max("segmentation_date").alias("segmentation_date")))


def worker_row(t, p: EligibilityParams, orders: DataFrame | None = None) -> DataFrame:
    """One row per driver with orders in the window, all aggregates attached.

    ``t`` exposes the logical tables (``Fixtures`` or any object with the same
    methods). Each part is unique on ``driver_id``; five counts are NULL -> 0
    while averages stay NULL (and so fail their rules), as in the reference.
    ``orders`` is a stored ``order_regions`` of the window, where there is one.
    """
    w = p.windows
    accounts = feat.id_map(t.accounts().where(F.col("tenant") == p.tenant))
    base = feat.stats_of_regions(feat.order_regions(t.wallet_orders(), w.orders) if orders is None else orders)
    parts = [
        accounts,
        latest_segment(t.segmentation()).select("driver_id", "segmentation_def"),
        feat.wallet_stats(t.daily_wallet(), w.wallet),
        feat.strikes_windowed(t.strikes(), w.strikes, p.strike_excluded),
        feat.seniority(t.deliveries(with_uuid=False), w.as_of, p.codes).select(
            "driver_id", "first_order", "seniority_days"),
        feat.recharges(t.billing(), w.billing, p.recharge_causes),
        feat.online_hours(t.supply_intervals(), w.supply),
        feat.route_completion(t.routes(), w.routes).select("driver_id", "prop_completed_routes",
                                                          "prop_declined_orders"),
    ]
    return zero_fill(fold_left(base, parts, "driver_id"), ZERO_FILLED)


def apply_rules(workers: DataFrame, rule_set: RuleSet) -> DataFrame:
    """One 0/1 column per rule and per setting, plus ``final_setting``."""
    cols = [flag(r.expr()).alias(r.name) for r in rule_set.rules]
    out = workers.select("*", *cols)
    settings = []
    for name, members in rule_set.settings.items():
        total = sum((F.col(m) for m in members), F.lit(0))
        settings.append(flag(total == len(members)).alias(name))
    out = out.select("*", *settings)
    chosen = F.lit(False)
    for regions, setting in rule_set.final:
        chosen = chosen | (F.col("logistic_region").isin(list(regions)) & (F.col(setting) == 1))
    return out.withColumn("final_setting", flag(chosen))


def final_segments(segmentation: DataFrame, rules: DataFrame, run_date: dt.date,
                   suffix: str = "Prueba") -> DataFrame:
    """Latest segment per driver by the run date, flagged and suffixed when finally selected.

    A NULL segment gives a NULL ``segment_nb`` (``concat`` semantics, X2).
    """
    seg = latest_segment(segmentation, run_date)
    sel = rules.select("driver_id", F.col("final_setting").alias("selected"))
    nb = F.when(F.col("selected") == 1, F.lit(suffix)).otherwise(F.lit(""))
    return (seg.join(sel, "driver_id", "left")
            .select("driver_id", F.col("segment_region").alias("logistic_region"),
                    F.lit(run_date).alias("date"), "segmentation_def", "selected",
                    F.concat(F.col("segmentation_def"), nb).alias("segment_nb")))


def selected_total(final: DataFrame) -> DataFrame:
    """Number of selected drivers overall (one row)."""
    return final.agg(F.sum("selected").alias("selected_drivers"))


def selected_by_region(final: DataFrame) -> DataFrame:
    """Selected drivers per region."""
    return (final.where(F.col("selected") == 1)
            .groupBy("logistic_region").agg(F.sum("selected").alias("selected_drivers")))


def selected_listing(final: DataFrame) -> DataFrame:
    """The selected rows themselves."""
    return final.where(F.col("selected") == 1)
