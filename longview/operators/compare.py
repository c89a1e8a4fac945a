"""Comparison of values along one dimension: difference or ratio against a base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import ordered
from longview.operators.common import attach, without

CONSECUTIVE, TOTAL = "Consecutive", "Total"
OPS = ("Difference", "Ratio")


def compare(df: DataFrame, op: str, col: str, base, y: str, slices=None) -> DataFrame:
    """Replace ``y`` by its difference from, or ratio to, a reference along ``col``.

    Groups are all columns but ``col`` and ``y``.  ``base`` is a value of ``col``,
    ``"Consecutive"`` (the preceding value of ``col``) or ``"Total"`` (the group sum).
    Base rows and rows without a result are removed.

    Whatever the column, no task has to hold a whole group: a base value or total is aggregated per group and joined
    back, and the preceding value comes from sliced groups (``slices`` of ``ordered.plan_slices``, else planned here).
    """
    if op not in OPS:
        raise ValueError(f"unknown comparison {op!r}")
    by = without(df.columns, col, y)
    if base == CONSECUTIVE:
        d = ordered.previous_value(df, y, by, [col], "__ref", slices)
    else:
        reference = F.sum(y) if base == TOTAL else F.max(F.when(F.col(col) == F.lit(base), F.col(y)))
        d = attach(df, by, df.groupBy(*by).agg(reference.alias("__ref")), ["__ref"])
    ref = F.col("__ref")
    if base not in (CONSECUTIVE, TOTAL):
        ref = F.coalesce(ref, F.lit(0))
        result = F.col(y) - ref if op == "Difference" else F.when(ref == 0, F.lit(0.0)).otherwise(S.ratio(y, ref))
    else:
        result = F.col(y) - ref if op == "Difference" else S.ratio(y, ref)
    d = d.withColumn(y, result).drop("__ref")
    if base not in (CONSECUTIVE, TOTAL):
        d = d.filter(~F.col(col).eqNullSafe(F.lit(base)))
    return d.filter(F.col(y).isNotNull())


def compare_chain(df: DataFrame, steps, y: str) -> DataFrame:
    """Apply up to three ``(op, col, base)`` steps one after the other."""
    for op, col, base in steps:
        df = compare(df, op, col, base, y)
    return df
