"""Ordered computations over groups of any size.

A window sorts a whole group inside one task.  That is right when the group runs
along the calendar, and wrong when one group may hold a third of all rows.  For
the second case the order column is cut into slices at approximate quantiles;
each task sorts one (group, slice) and a small per-slice summary carries the
state from slice to slice.  Results equal those of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.functions import scalars as S
from longview.operators.common import attach, group_count

SLICE = "__slice"
HALO = "__halo"
_POS = "__position"
ROWS_PER_SLICE = 2_000_000
# Accuracy of the sketch that places numeric cut points; texts drawn per slice to place text ones.
ACCURACY = 10_000
DRAWN = 200


@dataclass(frozen=True)
class Slices:
    """Cut points shared by all groups: texts for a text column, else numbers in its numeric image."""
    bounds: tuple = ()
    groups: int | None = None

    @property
    def summary_rows(self) -> int | None:
        """Bound on the rows of a per-slice summary, if the groups were counted."""
        return None if self.groups is None else self.groups * (len(self.bounds) + 1)

    def assign(self, df: DataFrame, order: str) -> DataFrame:
        if not self.bounds:
            return df.withColumn(SLICE, F.lit(0))
        if isinstance(self.bounds[0], str):
            below = F.size(F.filter(F.array(*[F.lit(b) for b in self.bounds]), lambda b: b <= F.col(order)))
            return df.withColumn(SLICE, F.when(F.col(order).isNull(), 0).otherwise(below))
        cut = Bucketizer(splits=[float("-inf"), *self.bounds, float("inf")],
                         inputCol=_POS, outputCol=SLICE, handleInvalid="keep")
        placed = df.withColumn(_POS, F.coalesce(position(df, order), F.lit(float("-inf"))))
        return cut.transform(placed).withColumn(SLICE, F.col(SLICE).cast("int")).drop(_POS)


def position(df: DataFrame, column: str) -> Column:
    """A double that never decreases along the sort order of ``column``."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # Wall-clock seconds: no time zone, so no hour is skipped or repeated.
        clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        return (F.unix_date(c.cast("date")).cast("double") * 86400) + clock
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    raise TypeError(f"cannot order slices by {kind.simpleString()}")


def plan_slices(df: DataFrame, order: str, by: list[str] | None = None,
                rows_per_slice: int = ROWS_PER_SLICE, least: int = 1) -> Slices:
    """Choose cut points so that no slice holds much more than ``rows_per_slice`` rows.

    Small inputs get a single slice (or ``least`` of them) after one counting job.  Larger ones take one
    sketch job over the order column; ``by`` adds an estimate of the number of groups
    to it, so that a small summary can be broadcast.
    """
    n = df.count()
    parts = max(-(-n // rows_per_slice), least)
    if parts <= 1 or not n:
        return Slices()
    if isinstance(df.schema[order].dataType, T.StringType):
        return Slices(_text_bounds(df, order, n, parts), None if by is None else group_count(df, by) if by else 1)
    at = df.select(position(df, order).alias(_POS), *([F.struct(*by).alias("__g")] if by else []))
    probs = [i / parts for i in range(1, parts)]
    count = [F.approx_count_distinct("__g")] if by else []
    row = at.agg(F.percentile_approx(_POS, probs, max(ACCURACY, 10 * parts)), *count).first()
    cuts = sorted({c for c in row[0] or [] if c == c and abs(c) != float("inf")})
    return Slices(tuple(cuts), row[1] if by else 1 if by == [] else None)


def _text_bounds(df: DataFrame, order: str, n: int, parts: int) -> tuple[str, ...]:
    """Quantiles of a draw of whole texts: a fixed number per slice, whatever the rows."""
    drawn = df.select(order).filter(F.col(order).isNotNull()).sample(min(1.0, DRAWN * parts / n), 7)
    texts = sorted((r[0] for r in drawn.collect()), key=lambda t: t.encode())
    return tuple(sorted({texts[i * len(texts) // parts] for i in range(1, parts)}, key=lambda t: t.encode())) if texts else ()


def _window(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by, SLICE).orderBy(*order)


def _plain(by: list[str], order: list[str]) -> Window:
    """The window of a table small enough for one slice."""
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)


def _to_end(by: list[str], place: str) -> Window:
    """The frame from a row to the end of its group, for rows numbered by ``place``: take ``last`` in it for the next.

    It runs from the end, where the state grows by a row at a time; Spark works a frame that ends with the group out anew
    for each row, which takes the square of the rows.
    """
    keys = by or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(F.col(place).desc()).rowsBetween(Window.unboundedPreceding, 0)


def _per_slice(df: DataFrame, by: list[str], aggs: list[Column], carried: dict[str, Column]) -> DataFrame:
    """One row per (group, slice) with the state arriving from earlier slices."""
    w = Window.partitionBy(*by).orderBy(SLICE) if by else Window.partitionBy(F.lit(0)).orderBy(SLICE)
    summary = df.groupBy(*by, SLICE).agg(*aggs)
    return summary.select(*by, SLICE, *[F.expr(e).over(w.rowsBetween(*rng)).alias(k)
                                        for k, (e, rng) in carried.items()])


_BEFORE = (Window.unboundedPreceding, -1)
_AFTER = (1, Window.unboundedFollowing)


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str,
                slices: Slices | None = None) -> DataFrame:
    """1-based row number inside each group."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    if not slices.bounds:
        return df.withColumn(out, F.row_number().over(_plain(by, order)).cast("long"))
    cut = slices.assign(df, order[0])
    carry = _per_slice(cut, by, [F.count(F.lit(1)).alias("__n")], {"__before": ("sum(__n)", _BEFORE)})
    local = cut.withColumn(out, F.row_number().over(_window(by, order)).cast("long"))
    both = attach(local, [*by, SLICE], carry, ["__before"], slices.summary_rows)
    return both.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop(SLICE, "__before")


def running_sum(df: DataFrame, y: str, by: list[str], order: list[str], out: str,
                slices: Slices | None = None) -> DataFrame:
    """Sum of ``y`` over the group's rows up to and including the current one."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    if not slices.bounds:
        return df.withColumn(out, F.sum(y).over(_plain(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = slices.assign(df, order[0])
    carry = _per_slice(cut, by, [F.sum(y).alias("__s")], {"__before": ("sum(__s)", _BEFORE)})
    w = _window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    both = attach(cut.withColumn(out, F.sum(y).over(w)), [*by, SLICE], carry, ["__before"], slices.summary_rows)
    total = F.when(F.col(out).isNull(), F.col("__before")).otherwise(
        F.col(out) + F.coalesce(F.col("__before"), F.lit(0)))
    return both.withColumn(out, total).drop(SLICE, "__before")


def previous_value(df: DataFrame, y: str, by: list[str], order: list[str], out: str,
                   slices: Slices | None = None) -> DataFrame:
    """``y`` of the preceding row of the group."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    if not slices.bounds:
        return df.withColumn(out, F.lag(y).over(_plain(by, order)))
    cut = slices.assign(df, order[0])
    last_row = F.max_by(F.struct(y), F.struct(*order)).alias("__last")
    carry = _per_slice(cut, by, [last_row], {"__prev": ("last(__last)", (-1, -1))})
    w = _window(by, order)
    local = (cut.withColumn(out, F.lag(y).over(w))
                .withColumn("__first", F.row_number().over(w) == 1))
    both = attach(local, [*by, SLICE], carry, ["__prev"], slices.summary_rows)
    return (both.withColumn(out, F.when(F.col("__first"), F.col("__prev").getField(y)).otherwise(F.col(out)))
                .drop(SLICE, "__first", "__prev"))


def fill_forward(df: DataFrame, y: str, by: list[str], order: list[str], out: str,
                 slices: Slices | None = None) -> DataFrame:
    """The latest known ``y`` at or before each row of the group."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    if not slices.bounds:
        w = _plain(by, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(y, True).over(w))
    cut = slices.assign(df, order[0])
    known = F.max_by(F.when(F.col(y).isNotNull(), F.struct(y)),
                     F.when(F.col(y).isNotNull(), F.struct(*order))).alias("__known")
    carry = _per_slice(cut, by, [known], {"__prev": ("last(__known, true)", _BEFORE)})
    w = _window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    both = attach(cut.withColumn(out, F.last(y, True).over(w)), [*by, SLICE], carry, ["__prev"], slices.summary_rows)
    return (both.withColumn(out, F.coalesce(F.col(out), F.col("__prev").getField(y)))
                .drop(SLICE, "__prev"))


def fill_backward(df: DataFrame, y: str, by: list[str], order: list[str], out: str,
                  slices: Slices | None = None) -> DataFrame:
    """The next known ``y`` at or after each row of the group."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    if not slices.bounds:
        placed = df.withColumn("__i", F.row_number().over(_plain(by, order)))
        return placed.withColumn(out, F.last(y, True).over(_to_end(by, "__i"))).drop("__i")
    cut = slices.assign(df, order[0])
    known = F.min_by(F.when(F.col(y).isNotNull(), F.struct(y)),
                     F.when(F.col(y).isNotNull(), F.struct(*order))).alias("__known")
    carry = _per_slice(cut, by, [known], {"__next": ("first(__known, true)", _AFTER)})
    placed = cut.withColumn("__i", F.row_number().over(_window(by, order)))
    local = placed.withColumn(out, F.last(y, True).over(_to_end([*by, SLICE], "__i")))
    both = attach(local, [*by, SLICE], carry, ["__next"], slices.summary_rows)
    return (both.withColumn(out, F.coalesce(F.col(out), F.col("__next").getField(y)))
                .drop(SLICE, "__i", "__next"))


def with_halo(df: DataFrame, by: list[str], order: list[str], carried: list[str], rows: int, slices: Slices) -> DataFrame:
    """Sliced rows, each slice led by copies of the ``rows`` rows before it in its group.

    Copies are marked in ``HALO`` and hold the keys, the order and the ``carried`` columns.  A slice lends its last
    ``rows`` rows to each slice that starts within that distance: to the next one, and where slices are shorter to
    several.  Which these are follows from the sizes of slices alone, so a window of fixed length sees its whole frame
    without the group in one place.
    """
    cut = slices.assign(df, order[0])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ends = cut.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    ends = ends.select(*by, SLICE, F.sum("__n").over(group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)).alias("__end"),
                       F.lead(SLICE).over(group.orderBy(SLICE)).alias("__next"))
    starts = F.collect_list(F.when(F.col("__next").isNotNull(), F.struct("__next", "__end"))).over(group.orderBy("__end").rangeBetween(0, rows - 1))
    ends = ends.select(*by, SLICE, "__end", starts.alias("__starts"))
    back = Window.partitionBy(*by, SLICE).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    last = cut.select(*by, SLICE, *order, *carried).withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= rows)
    last = attach(last, [*by, SLICE], ends, ["__end", "__starts"], slices.summary_rows)
    lent = last.select("*", F.explode("__starts").alias("__start")).filter(F.col("__end") - F.col("__back") + rows >= F.col("__start.__end"))
    lent = lent.select(*by, F.col("__start.__next").alias(SLICE), *order, *carried)
    return cut.withColumn(HALO, F.lit(False)).unionByName(lent.withColumn(HALO, F.lit(True)), allowMissingColumns=True)


def _in_halo(df: DataFrame, y: str, by: list[str], order: list[str], out: str, rows: int, slices: Slices, value) -> DataFrame:
    """``value`` (a function of a window) over the last ``rows`` rows and the current one."""
    kept = [*df.columns, *([] if out in df.columns else [out])]
    led = with_halo(df, by, order, [y], rows, slices)
    # Copies come from earlier slices; with equal order values they still lead.
    w = Window.partitionBy(*by, SLICE).orderBy(F.col(HALO).desc(), *order).rowsBetween(-rows, 0)
    return led.withColumn(out, value(w)).filter(~F.col(HALO)).select(*kept)


def rolling_sum(df: DataFrame, y: str, by: list[str], order: list[str], n: int, out: str,
                slices: Slices | None = None) -> DataFrame:
    """Sum of ``y`` over the last ``n`` rows of the group; null unless all ``n`` are there and known."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    value = lambda w: F.when(F.count(y).over(w) == n, F.sum(y).over(w))
    if not slices.bounds or n == 1:
        return df.withColumn(out, value(_plain(by, order).rowsBetween(-(n - 1), 0)))
    return _in_halo(df, y, by, order, out, n - 1, slices, value)


def fill_limited(df: DataFrame, y: str, by: list[str], order: list[str], limit: int, out: str,
                 slices: Slices | None = None) -> DataFrame:
    """The latest known ``y`` of the current row and the ``limit`` rows before it."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    value = lambda w: F.last(y, True).over(w)
    if not slices.bounds or limit == 0:
        return df.withColumn(out, value(_plain(by, order).rowsBetween(-limit, 0)))
    return _in_halo(df, y, by, order, out, limit, slices, value)


def interpolate(df: DataFrame, y: str, by: list[str], order: list[str], out: str,
                slices: Slices | None = None) -> DataFrame:
    """Linear interpolation by row position; a gap at the end keeps the last known value, one at the start stays null."""
    slices = plan_slices(df, order[0], by) if slices is None else slices
    w = _window(by, order) if slices.bounds else _plain(by, order)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(y).cast("double").alias("v")))
    local = ((slices.assign(df, order[0]) if slices.bounds else df).withColumn("__i", F.row_number().over(w).cast("long"))
             .withColumn("__a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("__b", F.last(known, True).over(_to_end([*by, SLICE] if slices.bounds else by, "__i"))))
    i, a, b = F.col("__i"), F.col("__a"), F.col("__b")
    if slices.bounds:
        group = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(SLICE)
        ends = local.groupBy(*by, SLICE).agg(F.max("__i").alias("__n"), F.max(known).alias("__last"), F.min(known).alias("__first"))
        ends = ends.withColumn("__rows", F.coalesce(F.sum("__n").over(group.rowsBetween(*_BEFORE)), F.lit(0)))
        at = lambda k: F.when(k.isNotNull(), F.struct((k["i"] + F.col("__rows")).alias("i"), k["v"].alias("v")))
        ends = ends.select(*by, SLICE, "__rows", F.last(at(F.col("__last")), True).over(group.rowsBetween(*_BEFORE)).alias("__prev"),
                           F.first(at(F.col("__first")), True).over(group.rowsBetween(*_AFTER)).alias("__next"))
        local = attach(local, [*by, SLICE], ends, ["__rows", "__prev", "__next"], slices.summary_rows)
        i, a, b = i + F.col("__rows"), F.coalesce(at(a), F.col("__prev")), F.coalesce(at(b), F.col("__next"))
    step = S.ratio(i - a["i"], b["i"] - a["i"])
    value = (F.when(F.col(y).isNotNull(), F.col(y).cast("double"))
              .when(b.isNull(), a["v"])
              .otherwise(a["v"] + (b["v"] - a["v"]) * step))
    return local.withColumn(out, value).drop(SLICE, "__i", "__a", "__b", "__rows", "__prev", "__next")


def values_at_ranks(df: DataFrame, y: str, by: list[str], ranks: dict, slices: Slices | None = None,
                    distinct: bool = False) -> DataFrame:
    """Exact order statistics: the value at each wanted 0-based rank of every group.

    ``ranks`` maps an output name to a function of the group size column.  Equal
    values travel as one counted row; only slices that hold a wanted rank are
    sorted, so a group is never gathered in one place.
    """
    slices = plan_slices(df, y, by) if slices is None else slices
    cut = slices.assign(df.select(*by, y).filter(F.col(y).isNotNull()), y)
    if distinct:
        counted = cut.groupBy(*by, SLICE, y).agg(F.lit(1).alias("__c"))
    else:
        counted = cut.groupBy(*by, SLICE, y).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if not slices.bounds:
        w = group.orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
        placed = (counted.withColumn("n", F.sum("__c").over(group)).withColumn("__hi", F.sum("__c").over(w))
                         .withColumn("__lo", F.col("__hi") - F.col("__c")))
    else:
        placed = _near_ranks(counted, y, by, ranks, group, slices.summary_rows)
    picks = [F.max(F.when((f(F.col("n")) >= F.col("__lo")) & (f(F.col("n")) < F.col("__hi")), F.col(y))).alias(k)
             for k, f in ranks.items()]
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def _near_ranks(counted: DataFrame, y: str, by: list[str], ranks: dict, group: Window,
                spans_rows: int | None) -> DataFrame:
    """Counted values of the slices that hold a wanted rank, with their rank range."""
    sizes = counted.groupBy(*by, SLICE).agg(F.sum("__c").alias("__n"))
    spans = (sizes.withColumn("n", F.sum("__n").over(group))
                  .withColumn("__before", F.coalesce(
                      F.sum("__n").over(group.orderBy(SLICE).rowsBetween(*_BEFORE)), F.lit(0))))
    holds = F.lit(False)
    for f in ranks.values():
        holds = holds | ((f(F.col("n")) >= F.col("__before")) & (f(F.col("n")) < F.col("__before") + F.col("__n")))
    rows = attach(counted, [*by, SLICE], spans.filter(holds), ["n", "__before"], spans_rows).filter(F.col("n").isNotNull())
    w = _window(by, [y]).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("__hi", F.sum("__c").over(w) + F.col("__before"))
                .withColumn("__lo", F.col("__hi") - F.col("__c")))


def quantiles(df: DataFrame, y: str, by: list[str], probs: dict[str, float],
              slices: Slices | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring values."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"__{name}_0"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"__{name}_1"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    at = values_at_ranks(df, y, by, ranks, slices)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"__{name}_0"), F.col(f"__{name}_1")
        share = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        out.append((lo + (hi - lo) * share).alias(name))
    return at.select(*by, *out)
