"""Data preparation: outliers, fills, grouped scaling with a registry, dedup
(D5-D7, D11-D15, O4).

Column summaries are always computed in one aggregate pass (all columns at once),
kept as a small table, and attached back: a one-row global aggregate by a
broadcast, a per-group table by an equi-join.
No per-column jobs, no per-group loops, no ``Window.partitionBy(region)`` over
the full data (a big city would land in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcraft.functions.columns import exact_mean, number
from fleetcraft.functions.joins import with_one_row


def _stat(c: str, kind: str) -> str:
    return f"__{kind}__{c}"


# ---------------------------------------------------------------------------
# Fills and outliers
# ---------------------------------------------------------------------------

def fill_with_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL -> mean of the column over all rows.

    Columns are cast to double first; filling a bigint with its mean would
    truncate (1.67 -> 1).
    """
    cols = [c for c in df.columns if c in set(columns)]
    if not cols:
        return df
    stats = df.agg(*[exact_mean(number(c)).alias(_stat(c, "mean")) for c in cols])
    out = with_one_row(df, stats)
    return out.select(*[
        F.coalesce(number(c), F.col(_stat(c, "mean"))).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def replace_outliers(df: DataFrame, columns: Sequence[str], mode: str = "std3",
                     strict: Sequence[str] = ()) -> DataFrame:
    """Replace high values by the column mean.

    ``mode="std3"`` is the reference rule: ``x >= 3 * std`` (``>`` for columns
    in ``strict``), with mean and sample std of the *original* column over all
    rows; the std is not added to the mean and only the upper tail is touched.
    ``mode="mean_plus_3std"`` uses ``x >= mean + 3 * std`` instead.
    """
    if mode not in ("std3", "mean_plus_3std"):
        raise ValueError("mode must be 'std3' or 'mean_plus_3std'")
    stats = df.agg(*[e for c in columns for e in (
        exact_mean(number(c)).alias(_stat(c, "mean")),
        F.stddev_samp(number(c)).alias(_stat(c, "std")))])
    out = with_one_row(df, stats)
    repl = {}
    for c in columns:
        mean, std = F.col(_stat(c, "mean")), F.col(_stat(c, "std"))
        limit = 3 * std if mode == "std3" else mean + 3 * std
        hit = (number(c) > limit) if c in set(strict) else (number(c) >= limit)
        repl[c] = F.when(hit, mean).otherwise(number(c)).alias(c)
    return out.select(*[repl.get(c, F.col(c)) for c in df.columns])


def drop_above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Drop rows with ``column >= threshold``; rows with NULL or NaN are kept
    (pandas ``~(x >= t)`` keeps NaN; Spark alone would rank it highest)."""
    return df.where(F.coalesce(~(number(column) >= threshold), F.lit(True)))


def count_above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """How many rows the threshold would drop."""
    return df.agg(F.count_if(number(column) >= threshold).alias("rows_above"),
                  F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------------------
# Grouped scaling with a registry of fitted parameters
# ---------------------------------------------------------------------------

def fit_minmax(df: DataFrame, features: Sequence[str], group: str | None = "logistic_region") -> DataFrame:
    """Min and max of each feature per group (or globally)."""
    aggs = [e for c in features for e in (F.min(number(c)).alias(_stat(c, "min")),
                                          F.max(number(c)).alias(_stat(c, "max")))]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def fit_standard(df: DataFrame, features: Sequence[str], group: str | None = "logistic_region") -> DataFrame:
    """Mean and population std of each feature per group (or globally)."""
    aggs = [e for c in features for e in (F.avg(number(c)).alias(_stat(c, "mean")),
                                          F.stddev_pop(number(c)).alias(_stat(c, "std")))]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def _minmax_expr(c: str) -> Column:
    lo, hi, x = F.col(_stat(c, "min")), F.col(_stat(c, "max")), number(c)
    # A constant feature has range 0: its scale is 1, so x - min (0 on the fitted data).
    return F.when(hi == lo, x - lo).otherwise((x - lo) / (hi - lo))


def _standard_expr(c: str) -> Column:
    mu, sd, x = F.col(_stat(c, "mean")), F.col(_stat(c, "std")), number(c)
    return F.when(sd == 0, x - mu).otherwise((x - mu) / sd)


def _apply(df: DataFrame, stats: DataFrame, features: Sequence[str], group: str | None, expr) -> DataFrame:
    if group is None:
        out = with_one_row(df, stats)
    else:
        # Inner join: rows of a group with no fitted parameters cannot be scaled.
        out = df.join(stats, group, "inner")
    return out.select(*[expr(c).alias(c) if c in set(features) else F.col(c) for c in df.columns])


def transform_minmax(df: DataFrame, stats: DataFrame, features: Sequence[str],
                     group: str | None = "logistic_region") -> DataFrame:
    """Apply fitted min-max parameters; values are not clipped (new data may leave [0, 1])."""
    return _apply(df, stats, features, group, _minmax_expr)


def transform_standard(df: DataFrame, stats: DataFrame, features: Sequence[str],
                       group: str | None = "logistic_region") -> DataFrame:
    return _apply(df, stats, features, group, _standard_expr)


def scale_minmax(df: DataFrame, features: Sequence[str], group: str | None = "logistic_region") -> DataFrame:
    """D11 (group) / D14 (``group=None``): fit and apply in one go."""
    return transform_minmax(df, fit_minmax(df, features, group), features, group)


def scale_standard(df: DataFrame, features: Sequence[str], group: str | None = "logistic_region") -> DataFrame:
    return transform_standard(df, fit_standard(df, features, group), features, group)


def update_registry(registry: DataFrame | None, df: DataFrame, features: Sequence[str],
                    group: str = "logistic_region", kind: str = "minmax") -> DataFrame:
    """Fit parameters only for groups the registry does not know yet.

    Known groups keep their old parameters; the result is the old registry plus
    the new groups (new = ``left_anti`` of the data's groups).
    """
    fit = fit_minmax if kind == "minmax" else fit_standard
    if registry is None:
        return fit(df, features, group)
    fresh = df.join(registry.select(group), group, "left_anti")
    return registry.unionByName(fit(fresh, features, group))


def unknown_groups(registry: DataFrame, df: DataFrame, group: str = "logistic_region") -> DataFrame:
    """The groups of the data that a registry does not know, each once, in order."""
    return df.select(group).where(F.col(group).isNotNull()).distinct().join(registry.select(group), group, "left_anti").orderBy(group)


# ---------------------------------------------------------------------------
# Dedup
# ---------------------------------------------------------------------------

def dedup_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by an explicit order (ties: whole-row order).

    ``min_by`` is a partial aggregate: a key holding a third of the rows is
    reduced map-side, never gathered into one task as a window would.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)
