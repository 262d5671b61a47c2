"""One driver owns a third of all rows: results stay exact (vs pandas brute
force) and aggregation is combined map-side before the shuffle."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetcraft.operators import features as feat
from fleetcraft.operators import prepare
from fleetcraft.functions.period import Period

N = 30_000


@pytest.fixture(scope="module")
def billing(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(N):
        driver = 1 if i % 3 == 0 else rnd.randint(2, 500)          # driver 1: a third of all rows
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 29))
        cause = rnd.choice(["TOP_UP", "WALLET_RECHARGE", "OTHER"])
        rows.append((driver, day, cause, float(rnd.randint(100, 100_000)), i))
    return spark.createDataFrame(rows, "driver_id long, day date, billing_cause string, quantity double, id long")


def test_recharges_exact_under_skew(spark, billing):
    got = {r.driver_id: r for r in feat.recharges(billing, Period("2024-01-01", "2024-01-30")).collect()}
    pdf = billing.toPandas()
    pdf = pdf[pdf.billing_cause.isin(feat.RECHARGE_CAUSES)]
    pdf["q"] = pdf.quantity / 100
    exp = pdf.groupby("driver_id").agg(recharges=("id", "count"), avg_recharge=("q", "mean"),
                                       days=("day", "nunique"), total=("q", "sum"))
    assert set(got) == set(exp.index)
    hot = got[1]
    assert hot.recharges == exp.loc[1, "recharges"] and hot.days_with_recharges == exp.loc[1, "days"]
    assert hot.total_recharges == pytest.approx(exp.loc[1, "total"], rel=1e-12)
    assert hot.avg_recharge == pytest.approx(exp.loc[1, "avg_recharge"], rel=1e-12)


def test_partial_aggregation_before_shuffle(spark, billing):
    plan = feat.recharges(billing, None)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan            # map-side combine
    first_exchange = plan.index("Exchange")
    assert "partial_" in plan[first_exchange:]  # partial aggregate feeds the first shuffle


def test_first_region_and_dedup_exact_under_skew(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(N):
        driver = 7 if i % 3 == 0 else rnd.randint(1, 300)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 40_000))
        rows.append((driver, i, ts, ts.date(), "MONEY" if i % 4 == 0 else "CARD", rnd.uniform(-5, 5),
                     f"R{rnd.randint(0, 9)}"))
    o = spark.createDataFrame(rows, "driver_id long, order_number long, date_timestamp timestamp_ntz, "
                                    "date_partition date, payment_type string, wallet_before_order double, "
                                    "logistic_region string")
    got = {r.driver_id: r.logistic_region for r in feat.order_stats(o, None).collect()}
    pdf = pd.DataFrame(rows, columns=["driver_id", "order_number", "ts", "d", "p", "w", "region"])
    first = pdf.sort_values(["ts", "order_number"]).groupby("driver_id").region.first()
    assert got == first.to_dict()
    dedup = prepare.dedup_first(o.select("driver_id", "order_number", "logistic_region"), "driver_id",
                                ["order_number"])
    assert dedup.count() == pdf.driver_id.nunique()
    assert dedup.where(F.col("driver_id") == 7).first().order_number == pdf[pdf.driver_id == 7].order_number.min()
