"""Workbooks written and read back through the data source."""

import datetime as dt
import glob
import os

import pytest

from fleetcraft.sources import workbooks
from fleetcraft.sources.tables import scratch_path

SCHEMA = "logistic_region string, n long, x double, ok boolean, day date, at timestamp, note string"
ROWS = [("Nation_1", 9007199254740993, 0.1, True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6), " a<b>&\"c\" "),
        ("a/b c", -1, float("inf"), False, None, None, "_x0041_ \x01 \r\n\t é 名"), (None, None, None, None, None, None, None),
        ("", 0, 1e-300, True, dt.date(1999, 12, 31), None, "")]


def files(path):
    return sorted(os.path.basename(p) for p in glob.glob(os.path.join(path.removeprefix("file:"), "*")))


def test_rows_come_back(spark):
    path = scratch_path(spark, "books")
    df = spark.createDataFrame(ROWS * 3, SCHEMA).repartition(3)
    workbooks.write_workbooks(df, path)
    assert sorted(map(str, workbooks.read_workbooks(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))
    assert all(f.endswith(".xlsx") for f in files(path))
    # an overwrite replaces, an append adds; a region over the row limit has several workbooks
    many = spark.range(25).selectExpr("'hot' AS logistic_region", "id AS n").coalesce(1)
    workbooks.write_workbooks(many, path, sheet_rows=10)
    assert len(files(path)) == 3
    workbooks.write_workbooks(many, path, mode="append")
    back = workbooks.read_workbooks(spark, path, many.schema)
    assert sorted(r["n"] for r in back.collect()) == sorted([*range(25)] * 2)
    workbooks.write_workbooks(many.where("n < 0"), path)
    assert files(path) == [] and workbooks.read_workbooks(spark, path, many.schema).count() == 0


def test_a_failed_write_leaves_the_old_workbooks(spark):
    path = scratch_path(spark, "books")
    df = spark.createDataFrame(ROWS, SCHEMA)
    workbooks.write_workbooks(df, path)
    old = files(path)
    with pytest.raises(Exception, match="does not fit"):
        workbooks.write_workbooks(df.selectExpr("logistic_region", "repeat('a', 40000) AS note"), path)
    assert files(path) == old
    with pytest.raises(TypeError):
        workbooks.write_workbooks(df.selectExpr("logistic_region", "array(n) AS n"), path)
