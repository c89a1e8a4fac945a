"""From yearly consumption of a division to hourly and time-slice demand of an area.

Column names: ``div`` division, ``ba`` area, ``state``, ``use`` end use, ``year``, ``hour``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import joins, ranking, reshape, windows

# Slice names and size of the peak slice.
PEAK_FROM, PEAK_TO, PEAK_HOURS = "H3", "H17", 40


def division_shares(counts: DataFrame, geo: DataFrame, value: str, by=("ba", "state", "div"), out: str = "share") -> DataFrame:
    """Share of each area in its division from counts of smaller units.

    Counts join the geography on their common columns; DC counts for Maryland.
    """
    d = joins.natural_join(counts, geo, "inner")
    if "state" in d.columns:
        d = d.withColumn("state", S.replace_value("state", "DC", "MD"))
    d = d.groupBy(*by).agg(F.sum(value).alias(value))
    return windows.share(d, value, ["div"], out).drop(value)


def industrial_shares(state_use: DataFrame, geo: DataFrame, ba_share: DataFrame, ref_year: int, years) -> DataFrame:
    """Yearly share of each area in its division, the reference year standing for later years."""
    d = joins.natural_join(state_use, geo.select("state", "div").distinct(), "inner")
    d = windows.share(d, "value", ["div", "year"], "__state")
    d = joins.natural_join(d.drop("value"), ba_share, "inner")
    d = d.select("ba", "state", "div", "year", (F.col("__state") * F.col("frac")).alias("share"))
    return joins.complete_from_reference(d, ref_year, years)


def historical_use(wide: DataFrame, divisions: DataFrame, names: str = "division") -> DataFrame:
    """Wide sales by region column to consumption (million btu) by division and year."""
    d = reshape.melt(wide, ["year"], None, names, "value")
    clean = F.regexp_replace(F.col(names), "^Commercial\\W+|[. ]million kilowatthours$", "")
    clean = F.replace(F.replace(clean, F.lit("."), F.lit(" ")), F.lit(" Contiguous"), F.lit(""))
    d = d.withColumn(names, F.trim(clean)).join(divisions, names, "inner")
    return d.groupBy("div", "year").agg((F.sum("value") * F.lit(S.MMBTU_PER_MILLION_KWH)).alias("value"))


def add_own_generation(use: DataFrame, own: DataFrame, keys: list[str], parts: list[tuple], value: str = "value") -> DataFrame:
    """Add fixed parts of own generation to some end uses, then sum up.

    ``own``: ``keys, kind, amount`` in long form; ``parts``: (condition on the use, {kind: fraction}).
    """
    kinds = sorted({k for _, shares in parts for k in shares})
    wide = reshape.pivot_first(own, keys, "kind", "amount", kinds)
    d = use.join(wide, keys, "left")
    total = F.col(value)
    for cond, shares in parts:
        extra = None
        for kind, share in sorted(shares.items()):
            one = F.col(kind) * F.lit(share)
            extra = one if extra is None else extra + one
        total = F.when(cond, F.col(value) + extra).otherwise(total)
    return d.withColumn(value, total).drop(*kinds)


def backcast(use: DataFrame, totals: DataFrame, ref_year: int, years) -> DataFrame:
    """End-use split of the reference year applied to earlier yearly totals, appended.

    ``use``: ``div, year, use, value``; ``totals``: ``div, year, value``.
    """
    split = windows.share(use.filter(F.col("year") == ref_year), "value", ["div"], "__share").select("div", "use", "__share")
    early = (totals.filter(F.col("year").isin(list(years))).join(split, "div", "inner")
             .select("div", "year", "use", (F.col("value") * F.col("__share")).alias("value")))
    return use.select("div", "year", "use", "value").unionByName(early)


def area_shapes(shapes: DataFrame, shares: DataFrame, uses: list[str]) -> DataFrame:
    """Hourly shape per area and end use: wide state shapes times the area's share."""
    long = shapes.unpivot(["state", "hour"], list(uses), "use", "shape")
    return long.join(shares, "state", "inner").select("ba", "div", "hour", "use", (F.col("shape") * F.col("share")).alias("shape"))


def hourly_profile(use: DataFrame, shapes: DataFrame) -> DataFrame:
    """Consumption per area, year and hour: the sum over end uses of use times shape.

    Consumption is summed before the join, so its side stays as small as divisions x
    years x uses; the product is summed per task before it is shuffled.
    """
    keys = ["div", "use"] if "use" in shapes.columns else ["div"]
    small = use.groupBy(*keys, "year").agg(F.sum("value").alias("__use"))
    on = [*keys, "year"] if "year" in shapes.columns else keys
    d = shapes.join(small, on, "inner")
    return d.groupBy("ba", "year", "hour").agg(F.sum(F.col("__use") * F.col("shape")).alias("value"))


def sector_total(*sectors: DataFrame) -> DataFrame:
    """Sum of the sectors' demand where all sectors have a value, joined by key."""
    out = None
    for i, s in enumerate(sectors):
        one = s.select("ba", "year", "hour", F.col("value").alias(f"__v{i}"))
        out = one if out is None else out.join(one, ["ba", "year", "hour"], "inner")
    total = F.col("__v0")
    for i in range(1, len(sectors)):
        total = total + F.col(f"__v{i}")
    return out.select("ba", "year", "hour", total.alias("value"))


def peak_hours(demand: DataFrame, time_map: DataFrame, n: int = PEAK_HOURS) -> DataFrame:
    """The ``n`` highest hours of the peak source slice per area and year; ties go to the earlier hour."""
    d = demand.join(time_map, "hour", "inner").filter(F.col("slice") == PEAK_FROM)
    return ranking.top_rows(d, ["ba", "year"], [F.col("value").desc(), F.col("hour")], n).select("ba", "year", "hour")


def relabel_peak(df: DataFrame, peaks: DataFrame) -> DataFrame:
    """Give the peak hours their own slice."""
    mark = peaks.withColumn("__peak", F.lit(True))
    return (df.join(mark, ["ba", "year", "hour"], "left")
              .withColumn("slice", F.when(F.col("__peak"), F.lit(PEAK_TO)).otherwise(F.col("slice"))).drop("__peak"))


def time_map_by_area(time_map: DataFrame, areas: DataFrame, peaks: DataFrame, years, ref_year: int, early_years) -> DataFrame:
    """Slice of every hour for every area and year; early years repeat the reference year."""
    base = joins.expand_values(areas.select("ba").distinct(), "year", list(years))
    full = relabel_peak(joins.expand_by(base, time_map.select("hour", "slice")), peaks)
    return joins.complete_from_reference(full, ref_year, early_years)


def slice_energy(demand: DataFrame, time_map: DataFrame | None = None) -> DataFrame:
    """Energy per area, year and slice in MWh (from million btu)."""
    d = demand if time_map is None else joins.natural_join(demand, time_map, "inner")
    return (d.groupBy(F.concat(F.lit("p"), F.col("ba").cast("string")).alias("ba"), "year", "slice")
             .agg((F.sum("value") * F.lit(S.MWH_PER_MMBTU)).alias("value")))


def slice_shapes(shapes: DataFrame, geo: DataFrame, time_map: DataFrame, uses: list[str]) -> DataFrame:
    """Time-slice shape by area and end use from hourly state shapes."""
    long = shapes.unpivot(["state", "hour"], list(uses), "use", "shape")
    d = long.join(geo.select("state", "ba", "div").distinct(), "state", "inner")
    d = joins.natural_join(d, time_map, "left")
    keys = ["ba", "div", *(["year"] if "year" in d.columns else []), "slice", "use"]
    return d.groupBy(*keys).agg(F.sum("shape").alias("shape"))
