"""Edge cases of FIXTURES.md section 4, one per semantic note of the survey."""

import datetime as dt
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetcraft.functions.columns import flag
from fleetcraft.functions.period import Period
from fleetcraft.operators import features as feat
from fleetcraft.operators import geo, prepare, profile
from fleetcraft.plans import feature_mart
from fleetcraft.plans.settings import FEATURES


def test_flag_on_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (1.0,)], "wallet double")
    got = [r.f for r in df.select(flag(F.col("wallet") < 0).alias("f")).collect()]
    assert got == [0, 1, 0]


def test_not_in_drops_null_class(spark):
    s = spark.createDataFrame([(1, dt.date(2024, 1, 2), "a", 1), (1, dt.date(2024, 1, 2), None, 2),
                               (1, dt.date(2024, 1, 2), "z", 3)],
                              "driver_id long, created_date date, strike_classification string, strike_id long")
    out = feat.strikes_windowed(s, Period("2024-01-01", "2024-01-31"), excluded=("a",)).collect()
    assert out[0].strikes == 1


def test_mean_fill_of_bigint_keeps_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x long")
    got = sorted(r.x for r in prepare.fill_with_mean(df, ["x"]).collect())
    assert got[:3] == [1.0, pytest.approx(5 / 3), 2.0] or pytest.approx(5 / 3) in got


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([("r", 5.0), ("r", 5.0), ("r", 5.0)], "logistic_region string, x double")
    assert {r.x for r in prepare.scale_minmax(df, ["x"]).collect()} == {0.0}
    assert {r.x for r in prepare.scale_standard(df, ["x"]).collect()} == {0.0}


def test_minmax_matches_formula_per_region(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 5.0), ("b", 1.0), ("b", 3.0)],
                               "logistic_region string, x double")
    got = sorted((r.logistic_region, r.x) for r in prepare.scale_minmax(df, ["x"]).collect())
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.0), ("b", 1.0)]


def test_outlier_rule(spark):
    df = spark.createDataFrame([(0.0,)] * 99 + [(1000.0,)], "x double")
    got = prepare.replace_outliers(df, ["x"]).agg(F.max("x")).first()[0]
    assert got == pytest.approx(10.0)
    same = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    assert {r.x for r in prepare.replace_outliers(same, ["x"]).collect()} == {5.0}
    tight = spark.createDataFrame([(100.0,), (101.0,), (102.0,)], "x double")
    assert {r.x for r in prepare.replace_outliers(tight, ["x"]).collect()} == {101.0}


def test_drop_above_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    assert prepare.drop_above(df, "x", 4).count() == 2


def test_skew_is_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "x double")
    assert profile.skew(df, ["x"]).first().skew == pytest.approx(1.6523167403, abs=1e-9)


def test_quartiles_exact_and_sketch(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = profile.describe(df, ["x"]).first()
    assert (r.p25, r.p50, r.p75) == (1.75, 2.5, 4.75)
    r = profile.describe(df, ["x"], interpolate=False).first()
    assert (r.p25, r.p50, r.p75) == (1.0, 2.0, 3.0)


@pytest.mark.parametrize("lat,lon,expected", [
    (4.6, -74.1, (4.6, -74.1, "inside")), (-74.1, 4.6, (4.6, -74.1, "swapped")),
    (4.6, 74.1, (4.6, -74.1, "lon_sign")), (74.1, 4.6, (4.6, -74.1, "swapped_lon_sign")),
    (40.0, 10.0, (None, None, "invalid")), (float("nan"), -74.1, (None, None, "invalid")),
    (None, -74.0, (None, None, "invalid")), (-4.6, -74.0, (None, None, "invalid")),
])
def test_geo_branches(spark, lat, lon, expected):
    df = spark.createDataFrame([(lat, lon)], "latitud double, longitud double")
    r = geo.repair_table(df).first()
    assert (r.lat, r.lon, r.repair) == expected


def _supply(spark, rows):
    return spark.createDataFrame(
        [("u", ts.date(), ts, secs) for ts, secs in rows],
        "driver_uuid string, date_partition date, interval_start_timestamp timestamp_ntz, "
        "interval_executed_seconds double")


def test_critical_hour_edges(spark):
    day = dt.date(2022, 9, 5)  # a Monday
    times = [(10, 59), (11, 0), (13, 59), (14, 0), (18, 0), (20, 0)]
    rows = [(dt.datetime.combine(day, dt.time(h, m)), 3600.0) for h, m in times]
    d = feat.supply_daily(_supply(spark, rows), None).first()
    assert d.critical_hours_executed == pytest.approx(3.0)  # 11:00, 13:59, 18:00
    assert d.hours_executed == pytest.approx(6.0)


def test_weekend_hours_by_day_of_week(spark):
    rows = [(dt.datetime(2022, 9, 2, 17, 0), 3600.0), (dt.datetime(2022, 9, 2, 18, 0), 3600.0),
            (dt.datetime(2022, 9, 3, 9, 0), 3600.0), (dt.datetime(2022, 9, 4, 9, 0), 3600.0)]
    got = {r.date_partition: r.hours_special for r in feat.supply_daily(_supply(spark, rows), None).collect()}
    assert got == {dt.date(2022, 9, 2): 1.0, dt.date(2022, 9, 3): 1.0, dt.date(2022, 9, 4): 1.0}


def test_duplicate_uuid_map_does_not_multiply(spark):
    workers = spark.createDataFrame([(1, "u1"), (1, "u1-dup")], "driver_id long, driver_uuid string")
    routes = spark.createDataFrame([(1, dt.date(2024, 1, 1), None)] * 3,
                                   "driver_id long, date_partition date, cancel_rejection_type string")
    r = feat.route_completion_by_uuid(routes, workers, None).collect()
    assert len(r) == 1 and r[0].total_routes == 3


def test_utr_skips_days_without_deliveries(spark):
    supply = _supply(spark, [(dt.datetime(2024, 1, 1, 12), 7200.0), (dt.datetime(2024, 1, 2, 12), 3600.0)])
    daily = feat.supply_daily(supply, None)
    facts = spark.createDataFrame([("u", dt.date(2024, 1, 1), 1), ("u", dt.date(2024, 1, 1), 2)],
                                  "driver_uuid string, date_partition date, order_delivery_uuid long")
    assert feat.utr(daily, facts).first().avg_daily_utr == pytest.approx(1.0)


def test_speed_is_null_on_zero_time(spark):
    d = spark.createDataFrame(
        [(1, "u", 1, 10, dt.date(2024, 1, 1), "R", 0.1, 400.0, 10.0, 25.0, "true", 0.0, 5.0, "F")],
        "driver_id long, driver_uuid string, order_uuid long, order_delivery_uuid long, date_partition date, "
        "logistic_region string, driver_consumer_evaluation double, delay double, real_delivery_time double, "
        "expected_delivery_time double, late_driver_flag string, time_to_destination double, distance_route double, "
        "last_status string")
    f = feat.delivery_facts(d, None, feat.DeliveryCodes("F", "P")).first()
    assert f.speed is None and f.is_critical_delay == 1 and f.is_ontime == 1


def test_rank_ties(spark):
    facts = spark.createDataFrame([("u", "A", 1), ("u", "B", 2), ("v", "A", 3), ("v", "A", 4), ("v", "B", 5)],
                                  "driver_uuid string, logistic_region string, order_delivery_uuid long")
    assert feat.main_region(facts, "all").count() == 3
    one = {(r.driver_uuid, r.logistic_region) for r in feat.main_region(facts, "one").collect()}
    assert one == {("u", "A"), ("v", "A")}


def test_earliest_order_region(spark):
    o = spark.createDataFrame(
        [(1, 10, dt.datetime(2024, 1, 2), dt.date(2024, 1, 2), "MONEY", 5.0, "LATE"),
         (1, 9, dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), "CARD", -5.0, "EARLY")],
        "driver_id long, order_number long, date_timestamp timestamp_ntz, date_partition date, "
        "payment_type string, wallet_before_order double, logistic_region string")
    r = feat.order_stats(o, None).first()
    assert (r.logistic_region, r.orders, r.perc_cash_orders, r.perc_negative_orders) == ("EARLY", 2, 0.5, 0.5)


def test_new_driver_without_orders_passes(spark):
    reg = spark.createDataFrame([(1, "ACTIVE", dt.datetime(2024, 1, 20), "bogota")],
                                "worker_id long, worker_state string, registration_approval_timestamp timestamp_ntz, "
                                "logistic_region string")
    workers = spark.createDataFrame([(1, "u1")], "driver_id long, driver_uuid string")
    deliveries = spark.createDataFrame([], "driver_uuid string, date_partition date, order_uuid long")
    r = feat.new_drivers(reg, workers, deliveries, dt.date(2024, 1, 30)).collect()
    assert [(x.driver_uuid, x.logistic_region, x.orders, x.antiquity) for x in r] == [("u1", "Bogota", 0, 10)]


def test_period_shift_matches_reference_window():
    p = Period.ending("2024-01-30", 15)
    assert (p.start, p.end, p.days) == (dt.date(2024, 1, 16), dt.date(2024, 1, 30), 15)
    assert math.isclose(Period.before("2024-01-31", 30).days, 30)


def test_exact_quantiles_match_pandas_with_coarse_sketch(spark):
    import random

    import pandas as pd
    rnd = random.Random(11)
    vals = [round(rnd.gauss(0, 10), 1) if rnd.random() > 0.1 else None for _ in range(5000)]
    ties = [rnd.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(5000)]
    df = spark.createDataFrame(list(zip(vals, ties)), "a double, b double")
    got = profile.exact_quantiles(df, ["a", "b"], (0.1, 0.25, 0.5, 0.75, 0.9), accuracy=50)
    for c, col in (("a", vals), ("b", ties)):
        s = pd.Series([v for v in col if v is not None])
        for g, q in zip(got[c], (0.1, 0.25, 0.5, 0.75, 0.9)):
            assert g == pytest.approx(s.quantile(q), abs=1e-9)


@pytest.mark.parametrize("n", [2, 3, 5, 53, 597])
def test_exact_quantiles_small_tables_interpolate(spark, n):
    import pandas as pd
    vals = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = profile.exact_quantiles(df, ["x"], (0.25, 0.5, 0.75))["x"]
    exp = [pd.Series(vals).quantile(q) for q in (0.25, 0.5, 0.75)]
    assert got == pytest.approx(exp, abs=1e-9)


def test_flags_are_summed_as_whole_numbers_and_stored_as_before(spark):
    facts = spark.createDataFrame(
        [("u", "R", 1, 1, 0, 1, 0.1, None), ("u", "R", 2, 1, 1, 0, 0.25, 3.5), ("u", "S", None, 0, 0, 1, None, 1.25)],
        "driver_uuid string, logistic_region string, order_delivery_uuid long, is_critical_delay int, "
        "driver_delay_origin int, is_ontime int, driver_consumer_evaluation double, speed double")
    sums = feat.region_days(facts, ("driver_uuid", "logistic_region"))
    assert {sums.schema[f"sum_{m}"].dataType.simpleString() for m in feat.MEANS} == {feat.EXACT}
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    for c in feat.FLAGS:
        assert f"sum({c}#" in plan
    row = feat.means_of_days(sums).first()
    assert row.asDict() == {"driver_uuid": "u", "prop_critical_delay": 0.6667, "driver_delay_origin": 0.3333, "speed": 2.375,
                            "consumer_evaluation": 0.175, "sla": 0.6667}


def test_main_region_and_means_come_of_one_pass(spark):
    facts = spark.createDataFrame(
        [("u", "S", 1, 1, 0, 1, 0.1, None), ("u", "R", 2, 1, 1, 0, 0.25, 3.5), ("u", None, 3, 0, 0, 1, None, 1.25),
         ("v", "S", 4, 0, 0, 0, 0.5, 2.0), ("v", "S", 4, 1, 0, 0, 0.5, 2.0), ("v", "R", None, 1, 1, 1, 0.25, 1.0),
         ("w", "Z", 5, 0, 0, 0, None, None), ("w", "B", 6, 0, 1, 0, None, None), ("x", None, 7, 1, 1, 1, 0.00005, 1.0)],
        "driver_uuid string, logistic_region string, order_delivery_uuid long, is_critical_delay int, "
        "driver_delay_origin int, is_ontime int, driver_consumer_evaluation double, speed double")
    sums = feat.region_sums(facts)
    assert {sums.schema[f"sum_{m}"].dataType.simpleString() for m, c in feat.MEANS.items() if c in feat.FLAGS} == {"bigint"}
    for ties in ("one", "all"):
        got = feat.region_and_means(sums, ties)
        want = feat.main_region(facts, ties).join(feat.delivery_kpis(facts), "driver_uuid").select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        feat.region_and_means(sums, "some")


def test_only_the_drivers_that_are_wanted_are_counted(spark):
    day = dt.date(2024, 1, 20)
    reg = spark.createDataFrame([(k, "ACTIVE", dt.datetime(2024, 1, 20), "bogota") for k in (1, 2, 3)],
                                "worker_id long, worker_state string, registration_approval_timestamp timestamp_ntz, "
                                "logistic_region string")
    workers = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "driver_id long, driver_uuid string")
    deliveries = spark.createDataFrame([("u1", day, 1, 10), ("u1", day, 1, 11), ("u2", day, 2, 20), ("u3", day, 3, 30), ("u3", day, 3, 30)],
                                       "driver_uuid string, date_partition date, order_uuid long, order_delivery_uuid long")
    as_of = dt.date(2024, 1, 30)
    among = spark.createDataFrame([("u1",), ("u1",), ("u3",), ("u9",), (None,)], "driver_uuid string")
    every = {r.driver_uuid: r for r in feat.new_drivers(reg, workers, deliveries, as_of).collect()}
    some = {r.driver_uuid: r for r in feat.new_drivers(reg, workers, deliveries, as_of, among=among).collect()}
    assert set(every) == {"u1", "u2", "u3"} and some == {u: every[u] for u in ("u1", "u3")}

    daily = spark.createDataFrame([("u1", day, 2.0, 1), ("u2", day, None, 0), ("u3", day, 0.5, 2), (None, day, 1.0, 1)],
                                  "driver_uuid string, date_partition date, positive_hours double, positive_intervals long")
    kept = feat.of_drivers_with_hours(deliveries, daily)
    assert {r.driver_uuid for r in kept.collect()} == {"u1", "u3"} and kept.count() == 4
    assert sorted(feat.utr(daily, kept).collect(), key=str) == sorted(feat.utr(daily, deliveries).collect(), key=str)


def _small_tables(spark):
    """Logical tables of three drivers: u1 has all that a feature row needs, u2 no hours, u3 another region."""
    day = dt.date(2024, 1, 20)
    ts = dt.datetime(2024, 1, 20, 12)
    rows = {
        "workers": ([(k, f"u{k}") for k in (1, 2, 3)], "driver_id long, driver_uuid string"),
        "deliveries": ([(k, f"u{k}", 10 * k + i, 100 * k + i, "F", day, "ELSEWHERE" if k == 3 else "NATION_1", 1.0, 0.5, 10.0, 25.0,
                         "true", 3600.0, 10.0) for k in (1, 2, 3) for i in range(k)],
                       "driver_id long, driver_uuid string, order_uuid long, order_delivery_uuid long, last_status string, "
                       "date_partition date, logistic_region string, delay double, driver_consumer_evaluation double, "
                       "real_delivery_time double, expected_delivery_time double, late_driver_flag string, "
                       "time_to_destination double, distance_route double"),
        "routes": ([(k, day, None) for k in (1, 2, 3)], "driver_id long, date_partition date, cancel_rejection_type string"),
        "supply_intervals": ([(k, day, ts, 3600.0, 1800.0) for k in (1, 3)], "driver_id long, date_partition date, "
                             "interval_start_timestamp timestamp_ntz, interval_executed_seconds double, interval_worked_seconds double"),
        "strikes": ([(1, day, "error", 1)], "driver_id long, created_date date, strike_classification string, strike_id long"),
        "billing": ([(1, day, "purchase", 5.0, 1)], "driver_id long, day date, billing_cause string, quantity double, id long"),
        "wallet_streak": ([(1, day, 1.0)], "driver_id long, date_partition date, sign double"),
        "worker_registration": ([(k, "ACTIVE", dt.datetime(2024, 1, 20), "NATION_1") for k in (1, 2, 3)],
                                "worker_id long, worker_state string, registration_approval_timestamp timestamp_ntz, logistic_region string"),
    }
    frames = {name: spark.createDataFrame(*r) for name, r in rows.items()}
    return SimpleNamespace(spark=spark, **{name: lambda df=df: df for name, df in frames.items()})


def test_the_feature_row_neither_stores_region_sums_nor_counts_drivers_it_drops(spark, monkeypatch):
    stored, store, among, build = [], feature_mart.materialise, [], feat.new_drivers
    monkeypatch.setattr(feature_mart, "materialise", lambda df, name: stored.append(name) or store(df, name))
    monkeypatch.setattr(feat, "new_drivers", lambda *a, **k: among.append(k["among"]) or build(*a, **k))
    row, = feature_mart.feature_row(_small_tables(spark), FEATURES).collect()
    assert (row.driver_uuid, row.logistic_region, row.sla, row.speed, row.avg_daily_utr, row.orders, row.antiquity) == (
        "u1", "Nation_1", 1.0, 10.0, 1.0, 1, 5)
    assert stored == ["supply-days", "joined-features"] and [r.driver_uuid for r in among[0].collect()] == ["u1"]
