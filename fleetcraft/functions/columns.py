"""Small column-expression helpers (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0. A NULL predicate gives 0 (E5)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with NULL instead of an error on a zero denominator (ANSI safe)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def round_mean(c: str | Column, digits: int) -> Column:
    """``round(avg(c), digits)`` that does not depend on row order.

    The mean is taken over exact decimals, so the result - and which way a
    value on a rounding tie goes - is the same for any partitioning.
    """
    return F.round(F.avg(col(c).cast("decimal(38,10)")), digits).cast("double")


MONEY = "decimal(38,6)"


def money_sum(c: str | Column) -> Column:
    """Exact sum of a currency amount (decimal), returned as double."""
    return F.sum(col(c).cast(MONEY)).cast("double")


def money_mean(c: str | Column) -> Column:
    """Exact mean of a currency amount: the decimal sum is exact, so the
    result does not depend on the order rows are added in."""
    return F.try_divide(F.sum(col(c).cast(MONEY)).cast("double"), F.count(col(c)).cast("double"))


def with_default(c: str | Column, default) -> Column:
    """NULL code -> default."""
    return F.coalesce(col(c), F.lit(default))


def region_name(c: str | Column) -> Column:
    """Canonical region label: ``initcap`` of the raw name."""
    return F.initcap(F.trim(col(c)))


def zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NULL -> 0 on a subset (D7, X10), keeping each column's type."""
    cols = set(columns)
    return df.select(*[
        F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def number(c: str) -> Column:
    """A column as double, NaN as NULL: a missing number is NULL everywhere."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))



def exact_mean(x: Column) -> Column:
    """Mean of a double column that does not depend on the order rows are added in.

    Values are added as decimals of ten places; if one does not fit, the plain
    mean of the doubles is taken."""
    exact = x.try_cast("decimal(38,10)")
    return F.when(F.count(exact) == F.count(x), F.try_divide(F.try_sum(exact).cast("double"), F.count(x).cast("double"))) \
        .otherwise(F.avg(x))
