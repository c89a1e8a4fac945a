"""Chart and map data: stacks, levels, bounds, bars, box plots, polygons, legends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import ordered, ranking, windows
from longview.operators.common import attach, once, without
from longview.operators.joins import expand_by


def net_level(df: DataFrame, y: str, keys: list[str], out: str | None = None) -> DataFrame:
    """Sum over the series of each remaining key, beside every row."""
    return windows.group_total(df, y, keys, out or f"Net Level {y}")


def cumulative_key(df: DataFrame, y: str, keys: list[str], descending: bool = False,
                   out: str = "y_cumulative") -> DataFrame:
    """Sort key: the same sum, negated for a descending order."""
    total = windows.group_total(df, y, keys, out)
    return total.withColumn(out, -F.col(out)) if descending else total


def between_series_range(df: DataFrame, x: list[str], y: str) -> DataFrame:
    return df.groupBy(*x).agg(F.min(y).alias("range_min"), F.max(y).alias("range_max"))


def stack_levels(df: DataFrame, x: str, y: str, series: str, by: list[str] | None = None,
                 order: list | None = None, slices=None) -> DataFrame:
    """Start and end level of each stacked segment, positives and negatives apart.

    Every series appears at every x of its panel; a missing pair has height zero.
    Series are stacked in the custom order, else by name.
    """
    by = list(by or [])
    df = once(df, *by, x)
    # Levels of all series at every x of their panel: outlines of areas need the missing ones too.
    names = [*by, x, series]
    each = df.select(*[F.col(c).alias(f"__{c}") for c in by], series).distinct()
    at = df.select(*by, x).distinct()
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        full = at.join(each, same).select(*names)
    else:
        full = expand_by(at, each)
    known = df.select(*[F.col(c).alias(f"__{c}" if c in names else c) for c in df.columns])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    df = full.join(known, same, "left").select(*df.columns).fillna(0, subset=[y])
    rank = ranking.order_rank(series, order) if order else F.lit(0)
    d = (df.withColumn("__rank", rank)
           .withColumn("__p", F.when(F.col(y) > 0, F.col(y)).otherwise(F.lit(0.0)))
           .withColumn("__n", F.when(F.col(y) < 0, F.col(y)).otherwise(F.lit(0.0))))
    keys = [*by, x]
    d = windows.running_sum(d, "__p", keys, ["__rank", series], "top_pos", slices)
    d = windows.running_sum(d, "__n", keys, ["__rank", series], "top_neg", slices)
    return (d.withColumn("base_pos", F.col("top_pos") - F.col("__p"))
             .withColumn("base_neg", F.col("top_neg") - F.col("__n"))
             .select(*df.columns, "base_pos", "top_pos", "base_neg", "top_neg"))


def net_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Top of the positive stack plus bottom of the negative stack per x."""
    return df.groupBy(*(by or []), x).agg(F.sum(y).alias("net"))


def axis_bounds(df: DataFrame, x: str | None, y: str, series: str | None = None, stacked: bool = False,
                ranged: bool = False, show_points: bool = True, bar_width: float | None = None) -> DataFrame:
    """One row with the shared axis limits of all panels; y limits always include zero."""
    half = 0.0 if bar_width is None else bar_width / 2
    zero = F.lit(0.0)
    if stacked:
        others = without(df.columns, y, *([series] if series else []))
        sums = df.groupBy(*others).agg(F.sum(F.when(F.col(y) < 0, F.col(y))).alias("__n"),
                                       F.sum(F.when(F.col(y) > 0, F.col(y))).alias("__p"))
        low, high = F.min("__n"), F.max("__p")
        df = sums
    elif ranged:
        low, high = F.min("range_min"), F.max("range_max")
        if show_points:
            low, high = F.least(low, F.min(y)), F.greatest(high, F.max(y))
    else:
        low, high = F.min(y), F.max(y)
    xs = [(F.min(x) - F.lit(half)).alias("x_min"), (F.max(x) + F.lit(half)).alias("x_max")] if x else []
    return df.agg(*xs, F.least(zero, F.coalesce(low, zero)).alias("y_min"),
                  F.greatest(zero, F.coalesce(high, zero)).alias("y_max"))


def bar_positions(df: DataFrame, x: str, widths: DataFrame, by: list[str] | None = None,
                  order: list | None = None) -> DataFrame:
    """Gap-free bar centres from the width table, and widths relative to the widest.

    ``widths`` holds ``display, width``; a panel has at most one bar per entry of it.
    """
    side = widths.select(F.col("display").alias("__x"), "width")
    d = attach(df.join(side, F.col(x) == F.col("__x"), "left").drop("__x"), [],
               widths.agg(F.max("width").alias("__max")), ["__max"])
    keys = [ranking.order_rank(x, order), F.col(x)] if order else [F.col(x)]
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("cumulative", F.sum("width").over(w))
             .withColumn("position", F.col("cumulative") - F.col("width") / 2)
             .withColumn("relative_width", S.ratio("width", "__max"))
             .drop("__max"))


BOX_PROBS = {"q05": 0.05, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q95": 0.95}


def boxplot_stats(df: DataFrame, x: list[str], y: str, slices=None) -> DataFrame:
    """Exact 5/25/50/75/95 % values, box height and box centre per x."""
    q = ordered.quantiles(df, y, list(x), BOX_PROBS, slices)
    return (q.withColumn("iqr", F.col("q75") - F.col("q25"))
             .withColumn("box_center", (F.col("q25") + F.col("q75")) / 2))


def bar_range_text(df: DataFrame, center: str, width: float, out: str = "x_legend") -> DataFrame:
    """Hover text of a histogram bar: ``lo to hi``."""
    half = F.lit(width / 2)
    return df.withColumn(out, S.range_label(F.col(center) - half, F.col(center) + half))


# ---- maps ----------------------------------------------------------------------------

def planar_points(points: DataFrame, long: str = "long", lat: str = "lat") -> DataFrame:
    x, y = S.planar(long, lat)
    return points.withColumn("x", x).withColumn("y", y)


def kept_boundaries(points: DataFrame, data: DataFrame, region: str) -> DataFrame:
    """Boundary points that are no holes and belong to a region of the data."""
    regions = data.select(F.col(region).cast("string").alias("id"))
    return points.filter(~F.col("hole")).join(regions, "id", "left_semi")


def map_extent(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                      F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def polygons(points: DataFrame, group: str = "group", seq: str = "seq") -> DataFrame:
    """One row per polygon with its outline in order (one closed line per group)."""
    outline = F.sort_array(F.collect_list(F.struct(F.col(seq), F.col("x"), F.col("y"))))
    return points.groupBy(group).agg(F.min("id").alias("id"), outline.alias("outline"))


def outline_chunks(points: DataFrame, group: str = "group", seq: str = "seq", size: int = 4096, slices=None) -> DataFrame:
    """Outlines of any length in pieces of at most ``size`` points: group, chunk (from 0), id of the group, outline.

    Points are numbered by slices of the group, so that no task holds an outline; each piece starts with the last point
    of the one before, so that drawing the pieces gives the whole line.
    """
    d = ordered.number_rows(points, [group], [seq, "x", "y"], "__n", slices)
    at = ((F.col("__n") - 1) / F.lit(size)).cast("long")
    last = (F.col("__n") % size == 0) & (F.col("__n") > 0)
    in_chunks = F.when(last, F.array(at, at + 1)).otherwise(F.array(at))
    spread = d.select(group, "id", F.explode(in_chunks).alias("chunk"), F.struct(F.col(seq), F.col("x"), F.col("y")).alias("p"))
    whole = d.groupBy(group).agg(F.max("__n").alias("__all"), F.min("id").alias("__id"))
    pieces = spread.groupBy(group, "chunk").agg(F.sort_array(F.collect_list("p")).alias("outline"))  # at most size + 1 points
    both = attach(pieces, [group], whole, ["__all", "__id"])
    # The last point of a full last piece starts none.
    return both.filter(F.col("chunk") * size < F.col("__all")).select(group, "chunk", F.col("__id").alias("id"), "outline")


def arrow_ends(df: DataFrame, fraction: float) -> DataFrame:
    """Arrow head at ``fraction`` of the way from origin to destination."""
    return (df.withColumn("arrow_x", S.along("from_x", "to_x", fraction))
              .withColumn("arrow_y", S.along("from_y", "to_y", fraction)))


# ---- legends, domains and panels -----------------------------------------------------

def series_colors(df: DataFrame, series: str, order: list | None = None) -> DataFrame:
    """Distinct series with a running index in display order and the palette colour."""
    names = df.select(series).distinct()
    if order:
        names = names.withColumn("__rank", ranking.order_rank(series, order))
    d = ordered.number_rows(names, [], [*(["__rank"] if order else []), series], "__i")
    palette = F.array(*[F.lit(c) for c in ranking.SERIES_COLORS])
    index = (F.col("__i") - 1).cast("int")
    return d.select(series, index.alias("color_index"),
                    F.get(palette, index % F.lit(len(ranking.SERIES_COLORS))).alias("color"))


def legend(df: DataFrame, series: str, order: list | None = None) -> DataFrame:
    """Legend rows from bottom to top: reversed display order."""
    rows = series_colors(df, series, order)
    return rows.orderBy(F.col("color_index").desc())


def x_domain(df: DataFrame, x: str, x_group: str | None = None) -> DataFrame:
    """Category axis: distinct x, or every x for every group value."""
    if x_group is None:
        return df.select(x).distinct()
    from longview.operators.aggregate import grid
    return grid(df, [x_group, x]).withColumn("label", S.join_text(" ", x_group, x))


def panels(df: DataFrame, explode: str, explode_group: str | None = None) -> DataFrame:
    """Panels of a view with their row counts."""
    keys = [explode_group, explode] if explode_group else [explode]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
