"""Logical driver tables derived from the shared test tables.

The business code reads *logical* tables (``wallet_orders``, ``deliveries``,
``billing`` ...). On a real deployment they are catalog tables; for tests and
the bench they are derived from the TPC-H-style parquet files with the rules
below (a driver is a customer). The same rules exist as DuckDB SQL in
``fleetcraft.plans.oracle_views`` so each query has an independent oracle.

Scale notes: the big inputs (lineitem, orders, events) are only ever joined on
their own keys. The nation dimension is reduced to one row per known key, so its
size is bounded by construction and it may be broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.sources.tables import load

# Fixed values of the fixture mapping (see FIXTURES.md section 3).
SEGMENTATION_DATE = dt.datetime(2024, 1, 30)
TENANT = "co"
CASH_PRIORITY = "1-URGENT"
WALLET_OFFSET = 250_000.0
EXPECTED_DELIVERY_TIME = 25.0
NATION_COUNT = 25
# Deliveries and routes are spread over these days, so that they meet the events.
FIRST_DAY, DAYS = dt.date(2023, 12, 20), 45


def shifted_day(key: str):
    """The day of an order key: ``DAYS`` days from ``FIRST_DAY`` on."""
    return F.date_add(F.lit(FIRST_DAY), (F.col(key) % DAYS).cast("int"))


class Fixtures:
    """Lazily built logical tables over one test-data directory."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir
        self._memo: dict[str, DataFrame] = {}
        self._types: dict[str, T.StructType] = {}

    def _raw(self, name: str, *columns: str) -> DataFrame:
        """A raw table; its schema is read from the files once, not at each use."""
        if name not in self._types:
            self._types[name] = load(self.spark, self.base_dir, name).schema
        return load(self.spark, self.base_dir, name, list(columns) or None, self._types[name])

    def _once(self, key: str, build) -> DataFrame:
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    # -- dimensions ---------------------------------------------------------
    def nation(self) -> DataFrame:
        """Nation dimension: one row for each of the ``NATION_COUNT`` known keys at most, so it is broadcast."""
        n = self._raw("nation", "n_nationkey", "n_name").where(F.col("n_nationkey").between(0, NATION_COUNT - 1))
        return F.broadcast(n.groupBy("n_nationkey").agg(F.min("n_name").alias("n_name")))

    def workers(self) -> DataFrame:
        """id -> uuid map of the worker master table."""
        return self._raw("customer", "c_custkey", "c_name").select(
            F.col("c_custkey").alias("driver_id"), F.col("c_name").alias("driver_uuid"))

    def accounts(self) -> DataFrame:
        def build():
            c = self._raw("customer", "c_custkey", "c_name", "c_nationkey")
            return (c.join(self.nation(), c.c_nationkey == F.col("n_nationkey"), "left")
                    .select(F.col("c_custkey").alias("driver_id"),
                            F.col("c_name").alias("driver_uuid"),
                            F.lit(TENANT).alias("tenant"),
                            F.col("n_name").alias("logistic_region")))
        return self._once("accounts", build)

    def segmentation(self) -> DataFrame:
        def build():
            c = self._raw("customer", "c_custkey", "c_nationkey", "c_mktsegment")
            return (c.join(self.nation(), c.c_nationkey == F.col("n_nationkey"), "left")
                    .select(F.col("c_custkey").alias("driver_id"),
                            F.col("c_mktsegment").alias("segment"),
                            F.lit(SEGMENTATION_DATE).cast("timestamp_ntz").alias("segmentation_date"),
                            F.col("n_name").alias("logistic_region")))
        return self._once("segmentation", build)

    # -- order-based facts --------------------------------------------------
    def wallet_orders(self) -> DataFrame:
        def build():
            o = self._raw("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                          "o_totalprice")
            o = o.withColumn("_nk", (F.col("o_orderkey") % NATION_COUNT).cast("int"))
            return (o.join(self.nation(), F.col("_nk") == F.col("n_nationkey"), "left")
                    .select(F.col("o_custkey").alias("driver_id"),
                            F.col("o_orderkey").alias("order_number"),
                            F.col("o_orderdate").alias("date_timestamp"),
                            F.to_date("o_orderdate").alias("date_partition"),
                            F.when(F.col("o_orderpriority") == CASH_PRIORITY, F.lit("MONEY"))
                             .otherwise(F.col("o_orderpriority")).alias("payment_type"),
                            (F.col("o_totalprice") - F.lit(WALLET_OFFSET)).alias("wallet_before_order"),
                            F.col("n_name").alias("logistic_region")))
        return self._once("wallet_orders", build)

    def _supplier_nation(self) -> DataFrame:
        """supplier -> nation key."""
        return self._raw("supplier", "s_suppkey", "s_nationkey")

    def deliveries(self, with_uuid: bool = True) -> DataFrame:
        """Deliveries; ``with_uuid=False`` skips the uuid lookup (a shuffle of
        the orders) for callers keyed by driver id."""
        def build():
            o = self._raw("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
            if with_uuid:
                oc = o.join(self.workers(), o.o_custkey == F.col("driver_id"), "left").drop("driver_id")
            else:
                oc = o.withColumn("driver_uuid", F.lit(None).cast("string"))
            li = self._raw("lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_discount", "l_tax", "l_linestatus", "l_shipdate")
            d = li.join(oc, li.l_orderkey == oc.o_orderkey, "inner")
            d = d.join(self._supplier_nation(), d.l_suppkey == F.col("s_suppkey"), "left")
            # every other delivery is in the driver's own region, the rest where the supplier is
            d = d.withColumn("_nk", F.when(F.col("l_linenumber") % 2 == 0, F.col("s_nationkey"))
                             .otherwise(F.col("o_custkey") % NATION_COUNT).cast("int"))
            n = self.nation().select(F.col("n_nationkey"), F.upper("n_name").alias("logistic_region"))
            d = d.join(n, F.col("_nk") == F.col("n_nationkey"), "left")
            return d.select(
                F.col("o_custkey").alias("driver_id"),
                F.col("driver_uuid"),
                F.col("l_orderkey").alias("order_uuid"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_delivery_uuid"),
                F.col("l_orderkey").alias("order_number"),
                F.col("o_orderstatus").alias("last_status"),
                shifted_day("l_orderkey").alias("date_partition"),
                F.col("logistic_region"),
                F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("double").alias("delay"),
                F.col("l_discount").alias("driver_consumer_evaluation"),
                F.col("l_quantity").alias("real_delivery_time"),
                F.lit(EXPECTED_DELIVERY_TIME).alias("expected_delivery_time"),
                F.when(F.col("l_linestatus") == "F", F.lit("true")).otherwise(F.lit("false"))
                 .alias("late_driver_flag"),
                # some drivers have no travel time at all, so no speed
                F.when(F.col("o_custkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("l_tax") * 3600)
                 .alias("time_to_destination"),
                F.col("l_quantity").alias("distance_route"),
            )
        return self._once(f"deliveries-{with_uuid}", build)

    def routes(self) -> DataFrame:
        def build():
            o = self._raw("orders", "o_orderkey", "o_custkey")
            li = self._raw("lineitem", "l_orderkey", "l_returnflag")
            return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
                    .select(F.col("o_custkey").alias("driver_id"),
                            shifted_day("l_orderkey").alias("date_partition"),
                            F.nullif(F.col("l_returnflag"), F.lit("N")).alias("cancel_rejection_type")))
        return self._once("routes", build)

    def worker_registration(self) -> DataFrame:
        """Drivers with orders; approved over some 60 days, in their own region."""
        def build():
            d = self._raw("orders", "o_custkey").distinct()
            n = self.nation()
            approved = F.date_add(F.lit(FIRST_DAY), (F.col("o_custkey") % 60).cast("int")).cast("timestamp_ntz")
            return (d.join(n, (F.col("o_custkey") % NATION_COUNT).cast("int") == F.col("n_nationkey"), "left")
                    .select(F.col("o_custkey").alias("worker_id"),
                            F.when(F.col("o_custkey") % 4 == 0, F.lit("INACTIVE"))
                             .otherwise(F.lit("ACTIVE")).alias("worker_state"),
                            approved.alias("registration_timestamp"),
                            approved.alias("registration_approval_timestamp"),
                            F.col("n_name").alias("logistic_region")))
        return self._once("worker_registration", build)

    # -- event-based facts --------------------------------------------------
    def _events(self, *columns: str) -> DataFrame:
        return self._raw("events", *columns)

    def _with_uuid(self, e: DataFrame, with_uuid: bool) -> DataFrame:
        if with_uuid:
            return e.join(self.workers(), e.user_id == F.col("driver_id"), "left").drop("driver_id")
        return e.withColumn("driver_uuid", F.lit(None).cast("string"))

    def billing(self, with_uuid: bool = False) -> DataFrame:
        """Billing events; the uuid is looked up only for uuid-keyed callers."""
        def build():
            e = self._with_uuid(self._events("event_id", "ts", "user_id", "event_type", "value"), with_uuid)
            return (e
                    .select(F.col("user_id").alias("driver_id"), "driver_uuid",
                            F.to_date("ts").alias("day"),
                            F.col("event_type").alias("billing_cause"),
                            (F.col("value") * 100).alias("quantity"),
                            F.col("event_id").alias("id")))
        return self._once(f"billing-{with_uuid}", build)

    def daily_wallet(self) -> DataFrame:
        e = self._events("ts", "user_id", "value")
        return e.select(F.col("user_id").alias("driver_id"),
                        F.date_add(F.to_date("ts"), 1).alias("date_data"),
                        (F.col("value") - 50).alias("wallet"))

    def strikes(self) -> DataFrame:
        e = self._events("event_id", "ts", "user_id", "event_type")
        return e.select(F.col("user_id").alias("driver_id"),
                        F.to_date("ts").alias("created_date"),
                        F.col("event_type").alias("strike_classification"),
                        F.col("event_id").alias("strike_id"))

    def supply_intervals(self, with_uuid: bool = False) -> DataFrame:
        """Supply intervals; the uuid is looked up only for uuid-keyed callers."""
        def build():
            e = self._with_uuid(self._events("ts", "user_id", "value"), with_uuid)
            return (e
                    .select(F.col("user_id").alias("driver_id"), "driver_uuid",
                            F.to_date("ts").alias("date_partition"),
                            F.col("ts").alias("interval_start_timestamp"),
                            (F.col("value") * 60).alias("interval_executed_seconds"),
                            (F.col("value") * 30).alias("interval_worked_seconds")))
        return self._once(f"supply-{with_uuid}", build)

    def wallet_streak(self) -> DataFrame:
        e = self._events("ts", "user_id", "value")
        return e.select(F.col("user_id").alias("driver_id"),
                        F.to_date("ts").alias("date_partition"),
                        F.signum(F.col("value") - 50).alias("sign"))

    def coordinates(self) -> DataFrame:
        c = self._raw("customer", "c_custkey")
        k = F.col("c_custkey")
        a = (F.lit(-74) - k % 5).cast("double")
        b = (F.lit(4) + k % 7).cast("double")
        m = k % 6
        lat = (F.when(m == 0, b).when(m == 1, a).when(m == 2, b).when(m == 3, -a)
               .when(m == 4, F.lit(-40.0)).otherwise(F.lit(None).cast("double")))
        lon = (F.when(m == 0, a).when(m == 1, b).when(m == 2, -a).when(m == 3, b)
               .otherwise(F.lit(10.0)))
        return c.select(k.alias("id"), lat.alias("latitud"), lon.alias("longitud"))


# Declared schemas of the logical tables as produced above (Q6).
SCHEMAS: dict[str, T.StructType] = {
    "wallet_orders": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("order_number", T.LongType()),
        T.StructField("date_timestamp", T.TimestampNTZType()), T.StructField("date_partition", T.DateType()),
        T.StructField("payment_type", T.StringType()), T.StructField("wallet_before_order", T.DoubleType()),
        T.StructField("logistic_region", T.StringType())]),
    "billing": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("day", T.DateType()),
        T.StructField("billing_cause", T.StringType()), T.StructField("quantity", T.DoubleType()),
        T.StructField("id", T.LongType())]),
    "daily_wallet": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("date_data", T.DateType()),
        T.StructField("wallet", T.DoubleType())]),
    "strikes": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("created_date", T.DateType()),
        T.StructField("strike_classification", T.StringType()), T.StructField("strike_id", T.LongType())]),
    "routes": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("date_partition", T.DateType()),
        T.StructField("cancel_rejection_type", T.StringType())]),
    "coordinates": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("latitud", T.DoubleType()),
        T.StructField("longitud", T.DoubleType())]),
    "accounts": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("driver_uuid", T.StringType()),
        T.StructField("tenant", T.StringType()), T.StructField("logistic_region", T.StringType())]),
    "workers": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("driver_uuid", T.StringType())]),
    "segmentation": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("segment", T.StringType()),
        T.StructField("segmentation_date", T.TimestampNTZType()), T.StructField("logistic_region", T.StringType())]),
    "worker_registration": T.StructType([
        T.StructField("worker_id", T.LongType()), T.StructField("worker_state", T.StringType()),
        T.StructField("registration_approval_timestamp", T.TimestampNTZType()),
        T.StructField("logistic_region", T.StringType())]),
    "wallet_streak": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("date_partition", T.DateType()),
        T.StructField("sign", T.DoubleType())]),
    # driver_uuid of these two may be absent
    "deliveries": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("order_uuid", T.LongType()),
        T.StructField("order_delivery_uuid", T.LongType()), T.StructField("order_number", T.LongType()),
        T.StructField("last_status", T.StringType()), T.StructField("date_partition", T.DateType()),
        T.StructField("logistic_region", T.StringType()), T.StructField("delay", T.DoubleType()),
        T.StructField("driver_consumer_evaluation", T.DoubleType()), T.StructField("real_delivery_time", T.DoubleType()),
        T.StructField("expected_delivery_time", T.DoubleType()), T.StructField("late_driver_flag", T.StringType()),
        T.StructField("time_to_destination", T.DoubleType()), T.StructField("distance_route", T.DoubleType())]),
    "supply_intervals": T.StructType([
        T.StructField("driver_id", T.LongType()), T.StructField("date_partition", T.DateType()),
        T.StructField("interval_start_timestamp", T.TimestampNTZType()),
        T.StructField("interval_executed_seconds", T.DoubleType())]),
}
