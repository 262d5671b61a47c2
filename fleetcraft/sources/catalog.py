"""Logical tables read from a catalog or from paths (production source).

Same interface as ``Fixtures``: one method per logical table, so every
operator and job runs unchanged on real data. Each table is read by name
(``spark.table``) or by path (parquet), optionally checked against a declared
schema (Q6), and pruned to the columns the operators use.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcraft.sources import tables


class CatalogTables:
    """``locations`` maps a logical name to a catalog table or a path.

    Logical names: accounts, workers, segmentation, wallet_orders, deliveries,
    routes, worker_registration, billing, daily_wallet, strikes,
    supply_intervals, wallet_streak, coordinates. A value containing ``/``
    is read as parquet files, anything else as a catalog table.
    """

    def __init__(self, spark: SparkSession, locations: Mapping[str, str], check: bool = True):
        self.spark = spark
        self.locations = dict(locations)
        self.check = check

    def _read(self, name: str) -> DataFrame:
        where = self.locations[name]
        df = self.spark.read.parquet(where) if "/" in where else self.spark.table(where)
        if self.check and name in tables_schemas():
            tables.check_schema(df, tables_schemas()[name])
        return df

    def accounts(self) -> DataFrame:
        return self._read("accounts")

    def workers(self) -> DataFrame:
        return self._read("workers").select("driver_id", "driver_uuid")

    def segmentation(self) -> DataFrame:
        return self._read("segmentation")

    def wallet_orders(self) -> DataFrame:
        return self._read("wallet_orders")

    def deliveries(self, with_uuid: bool = True) -> DataFrame:
        df = self._read("deliveries")
        return df if with_uuid or "driver_uuid" in df.columns else df.withColumn(
            "driver_uuid", F.lit(None).cast("string"))

    def routes(self) -> DataFrame:
        return self._read("routes")

    def worker_registration(self) -> DataFrame:
        return self._read("worker_registration")

    def billing(self, with_uuid: bool = False) -> DataFrame:
        return self._with_uuid(self._read("billing"), with_uuid)

    def daily_wallet(self) -> DataFrame:
        return self._read("daily_wallet")

    def strikes(self) -> DataFrame:
        return self._read("strikes")

    def supply_intervals(self, with_uuid: bool = False) -> DataFrame:
        return self._with_uuid(self._read("supply_intervals"), with_uuid)

    def wallet_streak(self) -> DataFrame:
        return self._read("wallet_streak")

    def coordinates(self) -> DataFrame:
        return self._read("coordinates")

    def _with_uuid(self, df: DataFrame, with_uuid: bool) -> DataFrame:
        """Attach the uuid through the id map when the table lacks it."""
        if "driver_uuid" in df.columns:
            return df
        if not with_uuid:
            return df.withColumn("driver_uuid", F.lit(None).cast("string"))
        from fleetcraft.operators.features import id_map
        return df.join(id_map(self.workers()), "driver_id", "left")


def tables_schemas():
    from fleetcraft.sources.fixtures import SCHEMAS
    return SCHEMAS
