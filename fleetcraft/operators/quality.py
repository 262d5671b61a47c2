"""Data-quality checks as data (Q1-Q5).

All checks of a report are computed in one aggregate pass and returned as a
small DataFrame of (check, column, passed, observed, level, dataset); only
``gate`` brings that report (one row per check) to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_report(df: DataFrame, dataset: str, unique_key: str | None = None,
                   never_null: Sequence[str] = (), min_rows: int | None = None,
                   level: str = "CRITICAL") -> DataFrame:
    """Q1 (unique key), Q2 (never null), Q3 (more than ``min_rows`` rows), Q4 (level, name)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    if unique_key:
        aggs.append(F.count_distinct(unique_key).alias("__distinct"))
    aggs += [F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(never_null)]
    stats = df.agg(*aggs)

    def check(name: str, column: str | None, passed, observed):
        return F.struct(F.lit(name).alias("check"), F.lit(column).cast("string").alias("column"),
                        passed.alias("passed"), observed.cast("long").alias("observed"))

    checks = []
    if unique_key:
        checks.append(check("has_unique_key", unique_key,
                            F.col("__distinct") == F.col("__rows"), F.col("__rows") - F.col("__distinct")))
    for i, c in enumerate(never_null):
        checks.append(check("is_never_null", c, F.col(f"__null_{i}") == 0, F.col(f"__null_{i}")))
    if min_rows is not None:
        checks.append(check("has_num_rows_greater_than", None, F.col("__rows") > min_rows, F.col("__rows")))
    return (stats.select(F.explode(F.array(*checks)).alias("c"))
            .select("c.*", F.lit(level).alias("level"), F.lit(dataset).alias("dataset")))


def gate(report: DataFrame) -> DataFrame:
    """Raise when any check failed (the reference stops the job); else return the report."""
    failed = report.where(~F.col("passed")).collect()
    if failed:
        raise RuntimeError("data quality validation failed: " +
                           "; ".join(f"{r['check']}({r['column']}) observed={r['observed']}" for r in failed))
    return report


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Q5: keys seen more than once, most repeated first."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1)
            .orderBy(F.desc("count"), *keys))
