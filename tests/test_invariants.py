"""Invariants of SURVEY section 5 on the sf0.001 fixture."""

from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


SEGMENT_SF = "/root/testdata/sf0.01"   # the smallest with enough drivers for six subsegments


def _q(spark, name, sf=SF):
    return entry.queries()[name](spark, sf)


def test_one_row_per_driver_after_folds(spark):
    w = _q(spark, "worker_row")
    assert w.count() == w.select("driver_id").distinct().count()
    f = _q(spark, "feature_row")
    assert f.count() == f.select("driver_uuid").distinct().count()
    fin = _q(spark, "final_segments")
    assert fin.count() == fin.select("driver_id").distinct().count()


def test_final_selection_is_subset_of_setting(spark):
    r = _q(spark, "rules_active")
    assert r.where((F.col("final_setting") == 1) & (F.col("setting_1") != 1)).count() == 0


def test_subsegments_partition_their_parent(spark):
    h = _q(spark, "hierarchical_segments", SEGMENT_SF).cache()
    n = h.count()
    assert n == h.select("driver_uuid").distinct().count()
    bad = h.where(~F.col("subsegmentation").startswith(F.col("segmentation"))).count()
    assert bad == 0
    sizes = {r.subsegmentation: r["count"] for r in _q(spark, "subsegment_sizes", SEGMENT_SF).collect()}
    assert sum(sizes.values()) == n


def test_coverage_shares_of_one_setting_sum_to_one(spark):
    rows = _q(spark, "order_coverage").collect()
    for s in ("setting_1", "final_setting"):
        assert sum(r.orders for r in rows if r.setting == s) == sum(r.orders for r in rows if r.setting == "setting_1")
