"""Coordinate repair against a country bounding box.

Pure column expressions (no Python UDF): the repair is a ``when`` chain that
yields a named struct, so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoundingBox:
    lat: tuple[float, float]
    lon: tuple[float, float]


# Fixed values of the reference: the country box (inclusive bounds).
COLOMBIA = BoundingBox(lat=(-4.2316872, 16.0571269), lon=(-82.1243666, -66.8511907))

INSIDE, SWAPPED, LON_SIGN, SWAPPED_LON_SIGN, INVALID = (
    "inside", "swapped", "lon_sign", "swapped_lon_sign", "invalid")


def in_range(x: Column, bounds: tuple[float, float]) -> Column:
    """G1: ``lo <= x <= hi``; NULL and NaN are outside."""
    return F.coalesce(x.between(F.lit(bounds[0]), F.lit(bounds[1])), F.lit(False))


def _pair(lat: Column, lon: Column, kind: str) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"),
                    F.lit(kind).alias("repair"))


def repair(lat: str | Column, lon: str | Column, box: BoundingBox = COLOMBIA) -> Column:
    """First matching branch wins.

    1. inside the box -> unchanged; 2. swapped -> (lon, lat); 3. longitude
    sign flipped -> (lat, -lon); 4. swapped with the longitude sign flipped ->
    (lon, -lat); otherwise both NULL. The lat and lon ranges do not overlap, so
    at most one branch can match.
    """
    a = F.col(lat) if isinstance(lat, str) else lat
    b = F.col(lon) if isinstance(lon, str) else lon
    null = F.lit(None).cast("double")
    return (F.when(in_range(a, box.lat) & in_range(b, box.lon), _pair(a, b, INSIDE))
            .when(in_range(a, box.lon) & in_range(b, box.lat), _pair(b, a, SWAPPED))
            .when(in_range(a, box.lat) & in_range(-b, box.lon), _pair(a, -b, LON_SIGN))
            .when(in_range(-a, box.lon) & in_range(b, box.lat), _pair(b, -a, SWAPPED_LON_SIGN))
            .otherwise(_pair(null, null, INVALID)))


def repair_table(df: DataFrame, lat: str = "latitud", lon: str = "longitud",
                 box: BoundingBox = COLOMBIA) -> DataFrame:
    """Add repaired ``lat``, ``lon`` and the ``repair`` kind to every row."""
    return df.withColumn("__fix", repair(lat, lon, box)).select(
        *df.columns, "__fix.lat", "__fix.lon", "__fix.repair")


def repair_counts(repaired: DataFrame) -> DataFrame:
    """Rows per repair kind."""
    return repaired.groupBy("repair").agg(F.count(F.lit(1)).alias("rows"))
