"""Daily partial results: what a run reads, and that days add up."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetcraft.functions.period import Period
from fleetcraft.operators import features as feat
from fleetcraft.plans import daily_mart
from fleetcraft.plans.settings import EVENTS_15, FEATURES, fixtures
from fleetcraft.sources.tables import scratch_path

SF = "/root/testdata/sf0.001"


def windowed(period):
    return replace(FEATURES, windows=replace(FEATURES.windows, deliveries=period, supply=period))


@pytest.fixture(scope="module")
def filled(spark):
    t = fixtures(spark, SF)
    store = daily_mart.DayStore(spark, scratch_path(spark, "days"))
    assert store.days() == set()
    first = store.update(t, windowed(Period("2024-01-10", "2024-01-25")))
    assert len(first) == 16
    return t, store


def test_a_run_adds_only_the_days_it_lacks(spark, filled):
    t, store = filled
    assert store.update(t, FEATURES) == [dt.date(2024, 1, d) for d in range(26, 31)]
    assert store.update(t, FEATURES) == []
    again = [dt.date(2024, 1, 20)]
    before = sorted(map(str, store.region_days(EVENTS_15).collect()))
    assert store.update(t, FEATURES, again) == again
    assert sorted(map(str, store.region_days(EVENTS_15).collect())) == before and before


def test_days_add_up_to_the_window(spark, filled):
    t, store = filled
    store.update(t, FEATURES)
    facts = feat.delivery_facts(t.deliveries(), EVENTS_15, FEATURES.codes).cache()
    days = store.region_days(EVENTS_15)
    want = {r["driver_uuid"]: r.asDict() for r in feat.delivery_kpis(facts).collect()}
    got = {r["driver_uuid"]: r.asDict() for r in daily_mart.means_of_days(days).collect()}
    assert got == want and want
    for ties in ("one", "all"):
        assert sorted(daily_mart.main_region_of_days(days, ties).collect()) == sorted(feat.main_region(facts, ties).collect())
    with pytest.raises(ValueError):
        daily_mart.main_region_of_days(days, "some")
    facts.unpersist()


def test_other_days_are_not_read(spark, filled):
    _, store = filled
    days = store.region_days(Period("2024-01-12", "2024-01-13"))
    assert {r[0] for r in days.select(F.input_file_name()).distinct().collect()
            if "date_partition=2024-01-12" not in r[0] and "date_partition=2024-01-13" not in r[0]} == set()
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_partition" in plan


def test_a_missing_day_is_an_error_and_a_dead_run_is_repaired(spark, filled):
    t, store = filled
    with pytest.raises(ValueError, match="2024-02-01"):
        store.region_days(Period("2024-01-12", "2024-02-01"))
    other = daily_mart.DayStore(spark, scratch_path(spark, "days"))
    one = Period("2024-01-20", "2024-01-20")
    facts = feat.delivery_facts(t.deliveries(), one, FEATURES.codes)
    # a run that died after its first table: half the rows, no ledger
    daily_mart.write_partitioned(daily_mart.region_days(facts).limit(1), other._at("region_days"))
    assert other.days() == set() and other.update(t, windowed(one)) == [one.start]
    assert sorted(map(str, other.region_days(one).collect())) == sorted(
        map(str, daily_mart.region_days(facts).select(*other.region_days(one).columns).collect()))
    with pytest.raises(ValueError):
        other.update(t, replace(FEATURES, windows=replace(FEATURES.windows, supply=one)))
