"""Aggregations: view aggregations, roll-ups, densify, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import custom, ranking
from longview.operators.common import attach, group_count, numeric_columns
from longview.operators.joins import expand_by
from longview.operators.project import keep_for_grouping

MAX_DOMAIN = 10_000
BIG_GRID = 1_000_000

# Names of the view aggregations.
AGGREGATIONS = ("sum(a)", "ave(a)", "sum(a)/sum(b)", "sum(a*b)/sum(b)", "sum(a*b)/sum(c)",
                "[sum(a*b)/sum(b)]/[sum(a*c)/sum(c)]")


def aggregation(how: str, a, b=None, c=None) -> Column:
    """The aggregate expression behind a view aggregation name."""
    a = S.col(a)
    b = None if b is None else S.col(b)
    c = None if c is None else S.col(c)
    if how == "sum(a)":
        return F.coalesce(F.sum(a), F.lit(0))
    if how == "ave(a)":
        return F.avg(a)
    if how == "sum(a)/sum(b)":
        return S.ratio(F.sum(a), F.sum(b))
    if how == "sum(a*b)/sum(b)":
        return S.ratio(F.sum(a * b), F.sum(b))
    if how == "sum(a*b)/sum(c)":
        return S.ratio(F.sum(a * b), F.sum(c))
    if how == "[sum(a*b)/sum(b)]/[sum(a*c)/sum(c)]":
        return S.ratio(S.ratio(F.sum(a * b), F.sum(b)), S.ratio(F.sum(a * c), F.sum(c)))
    raise ValueError(f"unknown aggregation {how!r}")


def aggregate(df: DataFrame, by: list[str], how: str, a: str, b=None, c=None,
              within_range: bool = False) -> DataFrame:
    """One row per key with the aggregated ``a``, optionally its smallest and largest value.

    ``how`` names a built-in aggregation or a user's registered one.
    """
    if (own := custom.registered(how)) is not None:
        inputs = [c for c in dict.fromkeys([a, b, c]) if c is not None]
        found = custom.group_function(df, by, inputs, own)
        found = found.withColumnRenamed(found.columns[-1], a)
        if not within_range:
            return found
        return attach(found, by, df.groupBy(*by).agg(F.min(a).alias("range_min"), F.max(a).alias("range_max")), ["range_min", "range_max"])
    out = [aggregation(how, a, b, c).alias(a)]
    if within_range:
        out += [F.min(a).alias("range_min"), F.max(a).alias("range_max")]
    return df.groupBy(*by).agg(*out)


def _parts(how: str, a: str, b: str | None, c: str | None) -> tuple[dict[str, Column], Column]:
    """Sums that add up over any split of the rows, and the aggregation from them."""
    A, B, C = (None if x is None else F.col(x) for x in (a, b, c))
    total = lambda name: F.sum(name)
    if how == "sum(a)":
        return {"__a": F.sum(A)}, F.coalesce(total("__a"), F.lit(0))
    if how == "ave(a)":
        return {"__a": F.sum(A), "__n": F.count(A)}, S.ratio(total("__a"), total("__n"))
    if how == "sum(a)/sum(b)":
        return {"__a": F.sum(A), "__b": F.sum(B)}, S.ratio(total("__a"), total("__b"))
    if how == "sum(a*b)/sum(b)":
        return {"__ab": F.sum(A * B), "__b": F.sum(B)}, S.ratio(total("__ab"), total("__b"))
    if how == "sum(a*b)/sum(c)":
        return {"__ab": F.sum(A * B), "__c": F.sum(C)}, S.ratio(total("__ab"), total("__c"))
    if how == "[sum(a*b)/sum(b)]/[sum(a*c)/sum(c)]":
        parts = {"__ab": F.sum(A * B), "__b": F.sum(B), "__ac": F.sum(A * C), "__c": F.sum(C)}
        return parts, S.ratio(S.ratio(total("__ab"), total("__b")), S.ratio(total("__ac"), total("__c")))
    raise ValueError(f"unknown aggregation {how!r}")


def aggregate_top(df: DataFrame, by: list[str], how: str, a: str, b=None, c=None, within_range: bool = False,
                  series: str = "series", n: int = 10, other: str = "Other") -> DataFrame:
    """``aggregate`` after all but the ``n`` series largest by sum of absolute ``a`` became one, in one pass over ``df``.

    Rows are summed per key with the weight of their series beside the sums; series are ranked and renamed on those
    sums, which then add up once more.  Ties go to the smaller name.
    """
    if custom.registered(how) is not None:
        return aggregate(ranking.top_n_series(df, series, a, n, other), by, how, a, b, c, within_range)
    parts, result = _parts(how, a, b, c)
    if within_range:
        parts |= {"__lo": F.min(a), "__hi": F.max(a)}
    sums = df.groupBy(*by).agg(*[e.alias(k) for k, e in parts.items()], F.sum(F.abs(F.col(a))).alias("__w"))
    # Ranking and naming are one plan down to the shuffle of the sums, which then is made once, if both use all sums. The
    # last sort key never decides and the weight below is never negative, but the optimizer can't know.
    whole = F.max(F.struct(*parts)).alias("__all")
    top = (sums.groupBy(series).agg(F.sum("__w").alias("__w"), whole).orderBy(F.col("__w").desc(), F.col(series), F.col("__all")).limit(n)
               .select(F.col(series).alias("__top"), F.lit(True).alias("__kept")))
    if n <= ranking.MAX_BROADCAST_SERIES:
        top = F.broadcast(top)
    named = F.when(F.col("__kept") & F.col(series).isNotNull(), F.col(series).cast("string")).otherwise(F.lit(other))
    d = sums.filter("__w >= 0 OR __w IS NULL").join(top, F.col(series).eqNullSafe(F.col("__top")), "left").withColumn(series, named)
    out = [result.alias(a)]
    if within_range:
        out += [F.min("__lo").alias("range_min"), F.max("__hi").alias("range_max")]
    return d.groupBy(*by).agg(*out)


def sum_numeric(df: DataFrame, by: list[str]) -> DataFrame:
    """Group and sum every remaining numeric column; sums of nothing are zero."""
    values = [c for c in numeric_columns(df) if c not in by]
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def sum_over(df: DataFrame, group_cols, val_cols=None, drop_cols=None) -> DataFrame:
    """Roll up to ``group_cols``; rows with a missing key are left out."""
    kept = keep_for_grouping(df, group_cols, val_cols, drop_cols)
    return sum_numeric(kept.dropna(subset=list(group_cols)), list(group_cols))


GRAINS = ("year", "month", "day", "hour")


def rollup_time(df: DataFrame, dims: list[str], grain: str, values: list[str]) -> DataFrame:
    """Roll up to yearly, monthly, daily or hourly totals per ``dims``."""
    keys = [*dims, *GRAINS[:GRAINS.index(grain) + 1]]
    return sum_over(df, keys, val_cols=list(values))


# ---- densify -------------------------------------------------------------------------

def grid(df: DataFrame, index: list[str], domains: dict | None = None) -> DataFrame:
    """Every combination of the observed values of the index columns.

    Sizes are checked first with sketches in one job.  Domains of bounded size
    become arrays that rows explode in place; a domain beyond the bound stays a
    distributed list of distinct values.  ``domains`` gives known value lists.
    """
    domains = dict(domains or {})
    free = [c for c in index if c not in domains]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    size = {c: len(v) for c, v in domains.items()}
    if free:
        est = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(free)]).first()
        size |= {c: est[f"d{i}"] for i, c in enumerate(free)}
    small = [c for c in free if size[c] <= MAX_DOMAIN]
    large = [c for c in free if size[c] > MAX_DOMAIN]
    lists = df.agg(*[F.collect_set(c).alias(c) for c in small]) if small else None
    out, cells = None, 1
    for c in large:
        values = df.select(c).filter(F.col(c).isNotNull()).distinct()
        out = values if out is None else out.crossJoin(values)
        cells *= size[c]
    for c in sorted([*domains, *small], key=lambda c: -size[c]):
        if c in domains:
            items = F.array(*[F.lit(v).cast(kinds[c]) for v in domains[c]])
        else:
            items = lists.select(c).scalar()
        if out is None:
            out = df.sparkSession.range(1).select(F.explode(items).alias(c))
        else:
            if not large and cells * size[c] > BIG_GRID:
                out = out.repartition(*out.columns)
            out = out.select("*", F.explode(items).alias(c))
        cells *= size[c]
    return out.select(*index)


def densify(df: DataFrame, index: list[str], values: list[str] | None = None, fill=0,
            domains: dict | None = None) -> DataFrame:
    """Sum to the index, then add every missing combination of index values."""
    values = values or [c for c in numeric_columns(df) if c not in index]
    rolled = sum_over(df, index, val_cols=values)
    full = grid(df, index, domains).join(rolled, list(index), "left")
    return full.fillna(fill, subset=values) if fill is not None else full


# ---- histograms ----------------------------------------------------------------------

def histogram(df: DataFrame, y: str, bins: int, by: list[str] | None = None, weighted: bool = False,
              shared_edges: bool = True, out: str = "histogram_x") -> DataFrame:
    """Equal-width histogram of ``y``: bin centre and count (or sum of ``y``) per group.

    The last bin is closed.  If all values are equal the range is widened by one
    half on each side.  Every group gets all bins.
    """
    by = list(by or [])
    rows = df.select(*by, y).filter(F.col(y).isNotNull())
    edges = [F.min(y).cast("double").alias("__lo"), F.max(y).cast("double").alias("__hi")]
    if shared_edges or not by:
        rows = attach(rows, [], rows.agg(*edges), ["__lo", "__hi"])
    else:
        # Raw rows: the group count is checked so that they need not be shuffled.
        rows = attach(rows, by, rows.groupBy(*by).agg(*edges), ["__lo", "__hi"], group_count(rows, by))
    flat = F.col("__lo") == F.col("__hi")
    half = F.when(flat, F.lit(0.5)).otherwise(F.lit(0.0))
    rows = (rows.withColumn("__l", F.col("__lo") - half).withColumn("__h", F.col("__hi") + half)
                .withColumn("__w", (F.col("__h") - F.col("__l")) / F.lit(float(bins)))
                .withColumn("__bin", bin_number(F.col(y), F.col("__l"), F.col("__w"), bins)))
    weight = F.sum(y) if weighted else F.count(F.lit(1))
    counts = rows.groupBy(*by, "__l", "__w", "__bin").agg(weight.alias("__v"))
    # At most one entry per bin and group: the map stays small.
    packed = counts.groupBy(*by, "__l", "__w").agg(
        F.map_from_entries(F.collect_list(F.struct("__bin", "__v"))).alias("__m"))
    spread = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("__i"))
    centre = F.col("__l") + (F.col("__i") + F.lit(0.5)) * F.col("__w")
    height = F.coalesce(F.try_element_at("__m", F.col("__i")), F.lit(0))
    return spread.select(*by, centre.alias(out), height.alias(y))


def bin_number(y: Column, lo: Column, width: Column, bins: int) -> Column:
    """0-based equal-width bin, corrected where rounding put a value past an edge."""
    i = F.least(F.floor((y - lo) / width), F.lit(bins - 1)).cast("int")
    down = (y < lo + i * width).cast("int")
    up = ((i < bins - 1) & (y >= lo + (i + 1) * width)).cast("int")
    return i - down + up


# ---- further aggregates --------------------------------------------------------------

def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def drop_duplicates(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Full-row duplicates, or one row per key: the smallest remaining columns."""
    if not key:
        return df.distinct()
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct()
    picked = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r"))
    return picked.select(*key, "__r.*").select(*df.columns)


def named_aggregates(df: DataFrame, by: list[str], funcs: dict[str, str]) -> DataFrame:
    """Several columns with their own function (``sum``, ``avg``, ``min``, ``max``)."""
    fn = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(*by).agg(*[fn[f](c).alias(c) for c, f in funcs.items()])


def filtered_sum(value: str, cond: Column) -> Column:
    """Sum over the group's rows that meet ``cond``."""
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0))


def weighted_sum(df: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col(value) * F.col(weight)).alias(out))


def argmax_rows(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Rows holding the largest ``measure`` of their key; ties are all kept.

    The maximum is aggregated and joined back, so ties of a hot key need not meet in one task.
    """
    top = attach(df, by, df.groupBy(*by).agg(F.max(measure).alias("__top")), ["__top"])
    return top.filter(F.col(measure).eqNullSafe(F.col("__top"))).drop("__top")


def complete_categories(df: DataFrame, by: list[str], category: str, value: str) -> DataFrame:
    """Every category for every observed key; mean of duplicates, zero where missing.

    Keys and categories are laid out as rows, so a key that is null counts like any other;
    a null category is none.
    """
    mean = df.groupBy(*by, category).agg(F.avg(value).alias(value))
    kinds = mean.select(category).filter(F.col(category).isNotNull()).distinct()
    full = expand_by(mean.select(*by).distinct(), kinds)
    known = mean.select(*[F.col(c).alias(f"__{c}") for c in [*by, category]], value)
    same = F.col(category).eqNullSafe(F.col(f"__{category}"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return full.join(known, same, "left").select(*by, category, value).fillna(0, subset=[value])
