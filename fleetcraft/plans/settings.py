"""Query catalogue: every operator as a (Spark query, DuckDB oracle) pair.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the fixture tables of one
scale factor; its oracle is SQL over the raw tables (logical tables are CTEs
from ``oracle_views``). Column names match on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetcraft.functions.period import Period
from fleetcraft.operators import features as feat
from fleetcraft.operators.eligibility import EligibilityParams, EligibilityWindows, Rule, RuleSet
from fleetcraft.plans.feature_mart import FeatureParams, FeatureWindows
from fleetcraft.sources.fixtures import Fixtures

# Fixture parameters (FIXTURES.md section 3): windows and codes that give
# non-empty, partial results at every scale factor.
ORDERS_WINDOW = Period("1998-01-01", "2000-12-31")
EVENTS_15 = Period("2024-01-16", "2024-01-30")
EVENTS_30 = Period("2024-01-01", "2024-01-30")
SENIORITY_AS_OF = dt.date(2024, 1, 28)
NEW_DRIVER_AS_OF = dt.date(2024, 1, 25)
FEATURE_END = dt.date(2024, 1, 30)
RUN_DATE = dt.date(2024, 1, 31)
RECHARGE_CAUSES = ("purchase", "signup")
STRIKE_EXCLUDED = ("click", "view", "signup", "purchase")
CODES = feat.DeliveryCodes(completed="F", cancelled="P")
REGIONS = tuple(f"NATION_{i}" for i in range(10))

REGIONS_2 = tuple(f"NATION_{i}" for i in (0, 1, 2, 3, 4, 10, 11, 12, 13, 14))

ELIGIBILITY = EligibilityParams(
    windows=EligibilityWindows(orders=ORDERS_WINDOW, billing=EVENTS_30, wallet=EVENTS_30, strikes=EVENTS_15,
                               supply=EVENTS_30, routes=EVENTS_30, as_of=SENIORITY_AS_OF),
    recharge_causes=RECHARGE_CAUSES, strike_excluded=STRIKE_EXCLUDED, codes=CODES)

# The reference rule sets with thresholds moved to the fixture's value ranges.
RULES_ACTIVE = RuleSet(
    rules=(Rule("rule_1", "avg_wallet", ">=", 0), Rule("rule_2", "strikes", "<=", 8),
           Rule("rule_3", "seniority_days", ">", 30), Rule("rule_5", "avg_recharge", ">=", 40),
           Rule("rule_6", "prop_declined_orders", "<=", 0.72), Rule("rule_9", "orders", ">=", 20),
           Rule("rule_10", "orders", ">=", 3)),
    settings={"setting_1": ("rule_1", "rule_2", "rule_3", "rule_5", "rule_6", "rule_10")},
    final=((REGIONS, "setting_1"),),
)
RULES_ALTERNATE = RuleSet(
    rules=(Rule("rule_1", "avg_wallet", ">=", 0), Rule("rule_2", "strikes", "<=", 8),
           Rule("rule_3", "seniority_days", ">", 30),
           Rule("rule_4", "segmentation_def", "in", ("MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE")),
           Rule("rule_5", "avg_recharge", ">=", 40), Rule("rule_6", "prop_declined_orders", "<=", 0.72),
           Rule("rule_7", "online_hours", ">=", 60), Rule("rule_8", "online_hours", ">=", 30),
           Rule("rule_9", "orders", ">=", 5), Rule("rule_10", "orders", ">=", 3)),
    settings={"setting_1": ("rule_1", "rule_2", "rule_3", "rule_5", "rule_6", "rule_7", "rule_9"),
              "setting_2": ("rule_1", "rule_2", "rule_3", "rule_5", "rule_6", "rule_8", "rule_10")},
    final=((REGIONS, "setting_1"), (REGIONS_2, "setting_2")),
)

FEATURES = FeatureParams(
    windows=FeatureWindows(deliveries=EVENTS_15, routes=EVENTS_30, supply=EVENTS_15, billing=EVENTS_15, wallet=EVENTS_15,
                           end=FEATURE_END),
    new_driver_as_of=NEW_DRIVER_AS_OF, regions=REGIONS, recharge_causes=RECHARGE_CAUSES,
    strike_excluded=STRIKE_EXCLUDED, codes=CODES, ties="one")

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)
