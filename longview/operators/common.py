"""Small helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "{BLANK}"

NUMERIC = (T.NumericType,)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# A per-group table of at most this many rows is broadcast.
MAX_BROADCAST_GROUPS = 200_000


def group_count(df: DataFrame, by: list[str]) -> int:
    """Estimated number of groups: one sketch job over the key columns only."""
    return df.agg(F.approx_count_distinct(F.struct(*by))).first()[0]


def attach(df: DataFrame, by: list[str], totals: DataFrame, values: list[str], groups: int | None = None) -> DataFrame:
    """Put per-group ``values`` of ``totals`` beside every row of ``df``.

    ``groups`` is a checked bound on the rows of ``totals``: up to
    ``MAX_BROADCAST_GROUPS`` the rows of ``df`` are not shuffled at all.  Otherwise it
    is a plain equi-join whose hot keys adaptive execution splits.  Without keys
    the single row arrives as scalars.
    """
    if not by:
        return df.select("*", *[totals.select(v).scalar().alias(v) for v in values])
    right = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], *values)
    if groups is not None and groups <= MAX_BROADCAST_GROUPS:
        right = F.broadcast(right)
    cond = None
    for i, k in enumerate(by):
        one = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        cond = one if cond is None else cond & one
    return df.join(right, cond, "left").select(*df.columns, *values)


def once(df: DataFrame, *keys) -> DataFrame:
    """``df`` dealt by ``keys`` so that several uses of it in one query are computed once.

    Spark makes equal exchanges once, but uses that need different columns have different ones. The condition, true for
    every row though the optimizer can't know, keeps all columns in all uses, so that they are one plan down to the exchange.
    """
    return df.filter(F.xxhash64(*df.columns) >= F.lit(-2**63)).repartition(*keys)


def without(columns: list[str], *drop: str) -> list[str]:
    return [c for c in columns if c not in drop]
