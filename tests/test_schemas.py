"""Declared schemas of all logical tables (Q6)."""

import pytest

from fleetcraft.plans.settings import fixtures
from fleetcraft.sources import tables
from fleetcraft.sources.fixtures import SCHEMAS

NAMES = ("accounts", "workers", "segmentation", "wallet_orders", "deliveries", "routes", "worker_registration", "billing",
         "daily_wallet", "strikes", "supply_intervals", "wallet_streak", "coordinates")


def test_every_logical_table_has_a_schema():
    assert set(NAMES) == set(SCHEMAS)


@pytest.mark.parametrize("name", NAMES)
def test_tables_meet_their_schema_and_changes_are_seen(spark, name):
    df = getattr(fixtures(spark, "/root/testdata/sf0.001"), name)()
    assert tables.schema_problems(df, SCHEMAS[name]) == []
    first, *rest = SCHEMAS[name].fieldNames()
    assert tables.schema_problems(df.drop(first), SCHEMAS[name]) == [f"missing column {first}"]
    changed = df.withColumn(first, df[first].cast("binary" if df.schema[first].dataType.simpleString() == "string" else "string"))
    assert len(tables.schema_problems(changed, SCHEMAS[name])) == 1
    with pytest.raises(ValueError):
        tables.check_schema(changed, SCHEMAS[name])
    assert tables.schema_problems(df.selectExpr("*", "1 AS extra"), SCHEMAS[name]) == []
