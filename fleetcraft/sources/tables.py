"""Readers, writers and schema checks.

Everything here is a thin use of ``DataFrameReader`` / ``DataFrameWriter``;
no data passes through the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetcraft.session import checkpoint_dir

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


def load(spark: SparkSession, base_dir: str, name: str, columns: list[str] | None = None,
         schema: T.StructType | None = None) -> DataFrame:
    """Read one table by logical name (S1). ``columns`` prunes at the scan; a known ``schema`` saves reading a footer."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(os.path.join(base_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def load_with_options(spark: SparkSession, path: str, fmt: str = "parquet",
                      options: Mapping[str, str] | None = None, where: str | None = None) -> DataFrame:
    """Read with reader options and a constant filter."""
    df = spark.read.format(fmt).options(**(options or {})).load(path)
    return df.where(where) if where else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV export with a header and a *declared* schema (S3).

    Inferring types would need an extra pass over the data and can change
    from file to file; the schema is part of the contract instead.
    """
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header and no index (S7, S8 re-aimed)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local tmp)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, name: str = "temp") -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    Cuts the lineage (a lost executor re-reads the files instead of
    recomputing the whole plan) and lets later steps reuse the result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def overwrite_table(df: DataFrame, path: str) -> None:
    """Overwrite a result dataset."""
    df.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_by: str = "date_partition") -> None:
    """Append-by-partition with dynamic overwrite.

    Only the partitions present in ``df`` are replaced, so a re-run of one
    day is idempotent and other days stay untouched. No repartition by the
    date (a run writes one date, which would funnel the table through one
    task): every task writes its own file per date, sorted so it holds one
    open writer at a time.
    """
    (df.sortWithinPartitions(partition_by)
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_by)
       .parquet(path))


def register_views(spark: SparkSession, frames: Mapping[str, DataFrame]) -> None:
    """Expose frames to ``spark.sql``."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def schema_problems(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences between ``df.schema`` and a declared schema (Q6).

    Missing columns and type changes are problems; extra columns are not.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in expected.fields:
        if f.name not in have:
            out.append(f"missing column {f.name}")
        elif have[f.name] != f.dataType:
            out.append(f"column {f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}")
    return out


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Raise on a schema mismatch, else return ``df`` unchanged."""
    problems = schema_problems(df, expected)
    if problems:
        raise ValueError("schema check failed: " + "; ".join(problems))
    return df
