"""Inclusive date windows.

The reference derives its windows from the wall clock ("yesterday" and N days
back). Here a window is always an explicit argument so runs are repeatable and
oracles can match.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_date(value: dt.date | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class Period:
    """Closed interval ``[start, end]`` of calendar days."""

    start: dt.date
    end: dt.date

    def __post_init__(self):
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        if self.start > self.end:
            raise ValueError(f"empty period {self.start} > {self.end}")

    @classmethod
    def ending(cls, end: dt.date | str, days: int) -> Period:
        """``days`` calendar days up to and including ``end`` (15 -> end-14..end)."""
        end = _as_date(end)
        return cls(end - dt.timedelta(days=days - 1), end)

    @classmethod
    def before(cls, as_of: dt.date | str, days: int) -> Period:
        """The ``days`` days that end the day before ``as_of`` (yesterday-based runs)."""
        return cls.ending(_as_date(as_of) - dt.timedelta(days=1), days)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def contains(self, column: str | Column) -> Column:
        """Inclusive test on a date column; a literal range so parquet can prune."""
        c = F.col(column) if isinstance(column, str) else column
        return c.between(F.lit(self.start), F.lit(self.end))

    def contains_shifted(self, column: str | Column, shift_days: int) -> Column:
        """Test ``column + shift_days`` against the window without shifting the column.

        ``date_add(c, -1) between s and e`` equals ``c between s+1 and e+1``;
        the second form keeps the raw column so the predicate reaches the scan.
        """
        c = F.col(column) if isinstance(column, str) else column
        delta = dt.timedelta(days=shift_days)
        return c.between(F.lit(self.start - delta), F.lit(self.end - delta))

    def sql(self, column: str) -> str:
        """Same predicate as SQL text (for oracles and ``spark.sql``)."""
        return f"{column} BETWEEN DATE '{self.start}' AND DATE '{self.end}'"


def upto(column: str | Column, end: dt.date | str) -> Column:
    """Upper bound only (all history up to ``end`` inclusive)."""
    c = F.col(column) if isinstance(column, str) else column
    return c <= F.lit(_as_date(end))


def window_filter(period: Period | None, column: str | Column) -> Column:
    """``period.contains(column)``, or an always-true literal when no window."""
    return F.lit(True) if period is None else period.contains(column)
