"""Join helpers.

Joins are plain equi-joins; Spark broadcasts a side only where its size was
measured (AQE) or is known from its files. The one exception is a global
aggregate, which has one row by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row (global aggregate) frame to every row.

    A global aggregate has exactly one row by construction, so broadcasting
    it is always bounded; this is the only cross join in the library (J5).
    """
    return df.crossJoin(F.broadcast(one_row))


def fold_left(base: DataFrame, parts: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Chain of left joins from ``base``.

    Every part must be unique on ``on`` (each is built by a ``groupBy`` on the
    key, or deduplicated), so the fold never multiplies rows.
    """
    return reduce(lambda acc, part: acc.join(part, on, "left"), parts, base)
