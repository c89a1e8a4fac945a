"""Long/wide reshaping and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIVOT_COLUMNS = 10_000


def pivot_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values that become columns; a bounded driver-side list."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MAX_PIVOT_COLUMNS + 1).collect()
    if len(rows) > MAX_PIVOT_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_PIVOT_COLUMNS} values; keep the table long")
    return sorted(r[0] for r in rows)


def pivot_mean(df: DataFrame, index: list[str], column: str, value: str, values=None) -> DataFrame:
    """Wide table; duplicates are averaged and rows without any value dropped."""
    values = pivot_values(df, column) if values is None else list(values)
    wide = df.groupBy(*index).pivot(column, values).agg(F.avg(value))
    return wide.dropna(how="all", subset=[str(v) for v in values])


def pivot_strict(df: DataFrame, index: list[str], column: str, value: str, values=None) -> DataFrame:
    """Wide table; a duplicate (index, column) entry fails the query."""
    values = pivot_values(df, column) if values is None else list(values)
    single = df.groupBy(*index, column).agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate entries for pivot")).cast("double"))
         .otherwise(F.max(value)).alias(value))
    return single.groupBy(*index).pivot(column, values).agg(F.max(value))


def pivot_first(df: DataFrame, index: list[str], column: str, value: str, values=None) -> DataFrame:
    """Wide table from unique entries."""
    values = pivot_values(df, column) if values is None else list(values)
    return df.groupBy(*index).pivot(column, values).agg(F.first(value))


def melt(df: DataFrame, ids: list[str], values: list[str] | None, var: str, val: str) -> DataFrame:
    """Long table, one row per id and value column."""
    values = [c for c in df.columns if c not in ids] if values is None else values
    same = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return same.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], var, val)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Append rows by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def add_total(df: DataFrame, by: list[str], value: str, labels: dict[str, str]) -> DataFrame:
    """Append one total row per key, with the given label columns."""
    total = df.groupBy(*by).agg(F.sum(value).alias(value))
    for c, text in labels.items():
        total = total.withColumn(c, F.lit(text))
    return df.unionByName(total, allowMissingColumns=True)


def side_by_side(key: str, frames: list[DataFrame], fill=0) -> DataFrame:
    """Measures of several frames in one row per key, missing ones filled."""
    out = reduce(lambda a, b: a.join(b, key, "outer"), frames)
    return out.fillna(fill)


def with_identity(mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Mapping completed by value-to-itself rows; an existing entry wins."""
    own = mapping.select(F.col(key), F.col(value), F.lit(0).alias("__p"))
    same = mapping.select(F.col(value).alias(key), F.col(value), F.lit(1).alias("__p")).distinct()
    both = own.unionByName(same)
    return both.groupBy(key).agg(F.min_by(value, F.struct("__p", value)).alias(value))


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Swap rows and columns, ``index`` values becoming columns in their sort order."""
    values = [c for c in df.columns if c != index]
    long = df.select(F.col(f"`{index}`"), *[F.col(f"`{c}`") for c in values]).unpivot([F.col(f"`{index}`")], [F.col(f"`{c}`") for c in values], "key", "__value")
    return pivot_first(long, ["key"], index, "__value")
