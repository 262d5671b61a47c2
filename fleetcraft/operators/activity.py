"""Who is new and who came back, from the days a driver was active, and the calling order that follows (C11)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEW, STRONG, WEAK, REGULAR = "new", "reactivated_strong", "reactivated_weak", "regular"

# Fixed values of the reference: the calling order of subsegments with new and
# reactivated drivers, and the order of a second list, which names subsegments only.
FIRST_ORDER = {"AA": 1, "BC": 2, "BA": 3, "BD": 4, "BB": 5, "AB": 6}
FIRST_STATUS = {NEW: 2, STRONG: 2, WEAK: 4}
SECOND_ORDER = {"BB": 1, "BD": 2, "BA": 3, "AA": 4, "AB": 5, "BC": 6}


def activity_status(activity: DataFrame, as_of: dt.date, key: str = "driver_uuid", day: str = "date_partition",
                    gap_days: int = 30, recent_days: int = 30, strong_days: int = 10) -> DataFrame:
    """Per driver active by ``as_of``: ``first_day``, ``back_day`` (begin of the last stretch), ``stretches``,
    ``stretch_days`` (active days of the last) and ``status``.

    A stretch ends where the driver is away for more than ``gap_days`` days. A
    driver whose first day lies in the ``recent_days`` before ``as_of`` is new;
    one whose last stretch, not the first, begins there is reactivated, strongly
    with ``strong_days`` active days or more. Raw rows are reduced to (driver,
    day) first, so a window holds a driver's days, not rows.
    """
    days = activity.where((F.col(day) <= F.lit(as_of)) & F.col(key).isNotNull()).select(key, F.col(day).alias("d")).distinct()
    ordered = Window.partitionBy(key).orderBy("d")
    begins = F.coalesce(F.datediff("d", F.lag("d").over(ordered)) > gap_days, F.lit(True))
    placed = (days.withColumn("begins", begins.cast("int"))
              .withColumn("stretch", F.sum("begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0))))
    per = placed.groupBy(key, "stretch").agg(F.min("d").alias("begin"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy(key).agg(F.min("begin").alias("first_day"), F.max("begin").alias("back_day"), F.max("stretch").alias("stretches"),
                               F.max_by("n", "stretch").alias("stretch_days"))
    recent = F.date_sub(F.lit(as_of), recent_days)
    status = (F.when(F.col("first_day") > recent, NEW)
              .when((F.col("stretches") > 1) & (F.col("back_day") > recent),
                    F.when(F.col("stretch_days") >= strong_days, STRONG).otherwise(WEAK))
              .otherwise(REGULAR))
    return out.withColumn("status", status)


def prioritise(segments: DataFrame, status: DataFrame | None = None, order: Mapping[str, int] = FIRST_ORDER,
               by_status: Mapping[str, int] = FIRST_STATUS, key: str = "driver_uuid",
               keep: Sequence[str] = ("subsegmentation",)) -> DataFrame:
    """C11: every driver of either table with ``priority`` (1 first). A status that the order names decides before the
    subsegment; drivers that neither names have none. New drivers need no segment."""
    def number(column: str, named: Mapping[str, int]):
        out = F.lit(None).cast("int")
        for name, at in named.items():
            out = F.when(F.col(column) == name, F.lit(at)).otherwise(out)
        return out

    rows = segments.select(key, *keep)
    if status is None:
        return rows.withColumn("priority", number(keep[0], order))
    met = rows.join(status.select(key, "status"), key, "full")
    return met.withColumn("priority", F.coalesce(number("status", by_status), number(keep[0], order)))
