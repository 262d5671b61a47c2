"""Storage round trips, quality gate and the rule engine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.operators import eligibility as elig
from fleetcraft.operators import quality
from fleetcraft.sources import tables


def test_gate_raises_on_duplicate_key(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "driver_id long")
    report = quality.quality_report(df, "t", unique_key="driver_id")
    row = report.first()
    assert (row.check, row.passed, row.observed) == ("has_unique_key", False, 1)
    with pytest.raises(RuntimeError):
        quality.gate(report)
    ok = spark.createDataFrame([(1,), (2,)], "driver_id long")
    assert quality.gate(quality.quality_report(ok, "t", unique_key="driver_id")).count() == 1


def test_never_null_and_min_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    rows = {(r.check, r.column): (r.passed, r.observed) for r in
            quality.quality_report(df, "t", never_null=["a", "b"], min_rows=1000).collect()}
    assert rows[("is_never_null", "a")] == (True, 0)
    assert rows[("is_never_null", "b")] == (False, 1)
    assert rows[("has_num_rows_greater_than", None)] == (False, 2)


def test_duplicate_keys_report(spark):
    df = spark.createDataFrame([("u",), ("u",), ("v",)], "driver_uuid string")
    assert [(r.driver_uuid, r["count"]) for r in quality.duplicate_keys(df, "driver_uuid").collect()] == [("u", 2)]


def test_dynamic_partition_overwrite_keeps_other_dates(spark):
    path = tables.scratch_path(spark, "test-partitions")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 16)
    tables.write_partitioned(spark.createDataFrame([(1, d1), (2, d2)], "x long, date_partition date"), path)
    tables.write_partitioned(spark.createDataFrame([(3, d2)], "x long, date_partition date"), path)
    got = sorted((r.x, r.date_partition) for r in spark.read.parquet(path).collect())
    assert got == [(1, d1), (3, d2)]


def test_csv_roundtrip_with_declared_schema(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType()),
                           T.StructField("d", T.DateType())])
    df = spark.createDataFrame([("a", 0.1, dt.date(2024, 1, 30)), ("b", None, None)], schema)
    path = tables.scratch_path(spark, "test-csv")
    tables.write_csv(df, path)
    back = tables.check_schema(tables.read_csv(spark, path, schema), schema)
    assert sorted(back.collect(), key=lambda r: r.k) == sorted(df.collect(), key=lambda r: r.k)


def test_schema_problems(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    expected = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.StringType())])
    assert tables.schema_problems(df, expected) == ["column a: bigint != int", "missing column c"]


def test_materialise_reads_back_from_checkpoint_dir(spark):
    df = spark.range(5).withColumn("y", F.col("id") * 2)
    back = tables.materialise(df, "test")
    assert sorted(r.y for r in back.collect()) == [0, 2, 4, 6, 8]
    assert "LocalRelation" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_rule_engine_settings_and_final(spark):
    rules = elig.RuleSet(
        rules=(elig.Rule("r1", "avg_wallet", ">=", 0), elig.Rule("r2", "strikes", "==", 0),
               elig.Rule("r4", "segmentation_def", "in", ("Engaged",))),
        settings={"setting_1": ("r1", "r2"), "setting_2": ("r1", "r4")},
        final=((("A",), "setting_1"), (("B",), "setting_2")))
    df = spark.createDataFrame(
        [(1, "A", 5.0, 0, "Bad"), (2, "A", None, 0, "Engaged"), (3, "B", 1.0, 3, "Engaged"), (4, "C", 1.0, 0, "x")],
        "driver_id long, logistic_region string, avg_wallet double, strikes long, segmentation_def string")
    out = {r.driver_id: (r.r1, r.setting_1, r.setting_2, r.final_setting)
           for r in elig.apply_rules(df, rules).collect()}
    assert out == {1: (1, 1, 0, 1), 2: (0, 0, 0, 0), 3: (1, 0, 1, 1), 4: (1, 1, 0, 0)}


def test_final_segments_suffix_and_null_segment(spark):
    seg = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 1), "R"), (2, "Top", dt.datetime(2024, 1, 1), "R"),
                                 (2, "Old", dt.datetime(2023, 1, 1), "R")],
                                "driver_id long, segment string, segmentation_date timestamp_ntz, "
                                "logistic_region string")
    rules = spark.createDataFrame([(1, 1), (2, 1)], "driver_id long, final_setting int")
    out = {r.driver_id: (r.segmentation_def, r.segment_nb)
           for r in elig.final_segments(seg, rules, dt.date(2024, 1, 31)).collect()}
    assert out == {1: (None, None), 2: ("Top", "TopPrueba")}


def test_read_with_options_and_constant_filter(spark):
    path = tables.scratch_path(spark, "test-options")
    spark.createDataFrame([(1, "co"), (2, "br")], "driver_id long, tenant string").write.parquet(path)
    df = tables.load_with_options(spark, path, "parquet", {"mergeSchema": "false"}, where='tenant = "co"')
    assert [r.driver_id for r in df.collect()] == [1]
