"""Window operators along a calendar axis, and their any-size variants.

Without ``slices`` a plain window is used: right for groups that run along the
calendar.  Pass ``slices=ordered.plan_slices(df, order)`` for groups of unknown size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import ordered
from longview.operators.common import attach, group_count


def _over(by, order):
    return Window.partitionBy(*by).orderBy(*order)


def lag_by(df: DataFrame, y: str, by: list[str], order: list[str], out: str | None = None, slices=None) -> DataFrame:
    out = out or f"{y}_prev"
    if slices is not None:
        return ordered.previous_value(df, y, by, order, out, slices)
    return df.withColumn(out, F.lag(y).over(_over(by, order)))


def running_sum(df: DataFrame, y: str, by: list[str], order: list[str], out: str | None = None, slices=None) -> DataFrame:
    out = out or f"{y}_cum"
    if slices is not None:
        return ordered.running_sum(df, y, by, order, out, slices)
    return df.withColumn(out, F.sum(y).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_sum(df: DataFrame, y: str, by: list[str], order: list[str], n: int, out: str | None = None, slices=None) -> DataFrame:
    """Sum of the last ``n`` rows; null until ``n`` known values are there."""
    return ordered.rolling_sum(df, y, by, order, n, out or y, slices or ordered.Slices())


def ffill(df: DataFrame, y: str, by: list[str], order: list[str], limit: int | None = None,
          out: str | None = None, slices=None) -> DataFrame:
    """Forward fill, at most ``limit`` rows past the last known value."""
    slices = slices or ordered.Slices()
    if limit is None:
        return ordered.fill_forward(df, y, by, order, out or y, slices)
    return ordered.fill_limited(df, y, by, order, limit, out or y, slices)


def bfill(df: DataFrame, y: str, by: list[str], order: list[str], out: str | None = None, slices=None) -> DataFrame:
    return ordered.fill_backward(df, y, by, order, out or y, slices or ordered.Slices())


def interpolate(df: DataFrame, y: str, by: list[str], order: str | list[str], out: str | None = None, slices=None) -> DataFrame:
    """Linear interpolation by row position on a complete axis.

    A gap at the end keeps the last known value; a gap at the start stays null.
    """
    return ordered.interpolate(df, y, by, [order] if isinstance(order, str) else order, out or y, slices or ordered.Slices())


def group_total(df: DataFrame, y: str, by: list[str], out: str, raw: bool = False) -> DataFrame:
    """The group's sum beside every row, through a partial aggregate and an equi-join.

    ``raw=True`` is for unaggregated rows: it spends one sketch job on the number of
    groups, so that a small set of totals reaches the rows without shuffling them.
    """
    groups = group_count(df, by) if raw and by else None
    return attach(df, by, df.groupBy(*by).agg(F.sum(y).alias(out)), [out], groups)


def share(df: DataFrame, y: str, by: list[str], out: str = "share", raw: bool = False) -> DataFrame:
    """Each row's share of its group's sum."""
    return group_total(df, y, by, "__total", raw).withColumn(out, S.ratio(y, "__total")).drop("__total")


def complete_years(df: DataFrame, by: list[str], first, last, year: str = "year") -> DataFrame:
    """One row per group and year of ``first..last``; missing rows carry nulls."""
    axis = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year))
    return axis.join(df, [*by, year], "left")
