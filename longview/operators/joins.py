"""Lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators.common import once

MAX_INLINE_ROWS = 10_000
EXPAND_BUCKETS = 64


def one_row_per_key(lookup: DataFrame, key: str) -> DataFrame:
    """Lookup columns from the key rightwards, the smallest row of each key.

    Columns left of the key are dropped.  The pick does not depend on row order.
    """
    rest = lookup.columns[lookup.columns.index(key) + 1:]
    if not rest:
        return lookup.select(key).distinct()
    return lookup.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, "__r.*")


def join_attributes(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join of lookup attributes; rows without an entry are lost."""
    return df.join(one_row_per_key(lookup, key), key, "inner")


def map_values(df: DataFrame, column: str, mapping, seq: str | None = None) -> DataFrame:
    """Replace raw by display values; values without an entry pass through.

    ``mapping`` is a dict, or a frame ``raw, display`` whose last entry per raw
    value wins (by ``seq`` if given, else the largest display text).
    """
    if isinstance(mapping, dict):
        if not mapping:
            return df
        if len(mapping) <= MAX_INLINE_ROWS:
            table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
            return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), ["raw", "display"])
    pick = F.max_by("display", seq) if seq else F.max("display")
    table = mapping.groupBy(F.col("raw").alias("__raw")).agg(pick.alias("__display"))
    joined = df.join(table, F.col(column) == F.col("__raw"), "left")
    return (joined.withColumn(column, F.coalesce(F.col("__display"), F.col(column)))
                  .select(*df.columns))


def left_fill(df: DataFrame, other: DataFrame, on: list[str], measure: str, fill=0) -> DataFrame:
    """Left join with a default for the joined measure."""
    return df.join(other, on, "left").withColumn(measure, F.coalesce(F.col(measure), F.lit(fill)))


def outer_fill(a: DataFrame, b: DataFrame, on: list[str], fills: dict) -> DataFrame:
    """Full outer join; ``fills`` gives per column a literal or the column to copy."""
    d = a.join(b, on, "outer")
    for c, src in fills.items():
        d = d.withColumn(c, F.coalesce(F.col(c), F.col(src) if isinstance(src, str) else F.lit(src)))
    return d


def join_suffixed(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner",
                  suffixes=("_x", "_y")) -> DataFrame:
    """Equi-join in which equal non-key names of both sides get suffixes."""
    both = [c for c in a.columns if c in b.columns and c not in on]
    left = a.select(*[F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in a.columns])
    right = b.select(*[F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in b.columns])
    return left.join(right, on, how)


def left_on(a: DataFrame, b: DataFrame, left: str, right: str, values: dict) -> DataFrame:
    """Left join with different key names; ``values`` maps b's columns to new names."""
    side = b.select(F.col(right).alias("__k"), *[F.col(c).alias(n) for c, n in values.items()])
    return a.join(side, F.col(left) == F.col("__k"), "left").drop("__k")


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every common column name."""
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def keep_members(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other.select(on) if isinstance(on, str) else other.select(*on), on, "left_semi")


def drop_members(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other.select(on) if isinstance(on, str) else other.select(*on), on, "left_anti")


def unmapped(df: DataFrame, column: str, mapping: DataFrame, key: str | None = None) -> DataFrame:
    """Distinct values of ``column`` the mapping does not know."""
    known = mapping.select(F.col(key or column).alias(column))
    return df.select(column).distinct().join(known, column, "left_anti")


def expand_by(df: DataFrame, other: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of ``other``, whatever their sizes.

    The rows of ``other`` are numbered inside buckets of their hash. The number of rows of each bucket, a short array,
    goes to every row of ``df``, which counts it out in place; the numbers then meet their rows in an equi-join, which
    Spark broadcasts or deals by size. Neither table is collected, and no product is made by comparing rows.
    """
    bucket = F.pmod(F.xxhash64(*other.columns), F.lit(EXPAND_BUCKETS)).cast("int").alias("__b")
    number = F.row_number().over(Window.partitionBy("__b").orderBy(*other.columns))
    rows = once(other.select("*", bucket), "__b").withColumn("__i", number)
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).cast("int").alias("__n")).agg(F.collect_list(F.struct("__b", "__n")))
    each = df.select("*", F.inline(sizes.scalar())).select("*", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    return each.join(rows, ["__b", "__i"]).select(*df.columns, *other.columns)


def expand_values(df: DataFrame, column: str, values) -> DataFrame:
    """Every row of ``df`` once per given value."""
    return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def expand_years(df: DataFrame, first, last, year: str = "year") -> DataFrame:
    """Every row once per year between two columns or numbers, both included."""
    lo = S.col(first) if isinstance(first, str) else first if not isinstance(first, int) else F.lit(first)
    hi = S.col(last) if isinstance(last, str) else last if not isinstance(last, int) else F.lit(last)
    years = F.when(lo <= hi, F.sequence(lo, hi))
    return df.select("*", F.explode(years).alias(year))


def within_years(df: DataFrame, first: str, last: str, lo: int, hi: int, year: str = "year") -> DataFrame:
    """Rows expanded to the years of ``lo..hi`` inside their own first/last year.

    The range condition bounds the expansion itself, so no pair is built and dropped.
    """
    return expand_years(df, F.greatest(F.col(first), F.lit(lo)), F.least(F.col(last), F.lit(hi)), year)


def complete_from_reference(df: DataFrame, ref_year: int, years, year: str = "year") -> DataFrame:
    """Append copies of the reference year's rows for each of ``years``."""
    kind = df.schema[year].dataType
    copies = (df.filter(F.col(year) == ref_year).drop(year)
                .select("*", F.explode(F.array(*[F.lit(y).cast(kind) for y in years])).alias(year)))
    return df.filter(~F.col(year).isin(list(years))).unionByName(copies.select(*df.columns))


def link_endpoints(df: DataFrame, pair: str, centroids: DataFrame) -> DataFrame:
    """Planar start and end point of every origin-destination pair."""
    ends = df.withColumn("from", S.part(pair, "-", 0)).withColumn("to", S.part(pair, "-", 1))
    out = left_on(ends, centroids, "from", "id", {"x": "from_x", "y": "from_y"})
    return left_on(out, centroids, "to", "id", {"x": "to_x", "y": "to_y"})


def regions_with_values(boundaries: DataFrame, values: DataFrame, region: str, value: str,
                        missing: str = "NA") -> DataFrame:
    """Every boundary region with its value as text, or the marker where there is none."""
    side = values.select(F.col(region).alias("id"), F.col(value).cast("string").alias(value))
    return (boundaries.join(side, "id", "left")
                      .withColumn(value, F.coalesce(F.col(value), F.lit(missing))))
