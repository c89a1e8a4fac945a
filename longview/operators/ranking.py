"""Ordering, top-N and binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import ordered

MAX_BROADCAST_SERIES = 10_000
MAX_STYLE_ROWS = 10_000

# Labels of the 17 standard time slices.
TIMESLICE_LABELS = {
    "h1": "h01 (Summer 10pm-6am)", "h2": "h02 (Summer 6am-1pm)",
    "h3": "h03 (Summer 1pm-5pm)", "h4": "h04 (Summer 5pm-10pm)",
    "h5": "h05 (Fall 10pm-6am)", "h6": "h06 (Fall 6am-1pm)",
    "h7": "h07 (Fall 1pm-5pm)", "h8": "h08 (Fall 5pm-10pm)",
    "h9": "h09 (Winter 10pm-6am)", "h10": "h10 (Winter 6am-1pm)",
    "h11": "h11 (Winter 1pm-5pm)", "h12": "h12 (Winter 5pm-10pm)",
    "h13": "h13 (Spring 10pm-6am)", "h14": "h14 (Spring 6am-1pm)",
    "h15": "h15 (Spring 1pm-5pm)", "h16": "h16 (Spring 5pm-10pm)",
    "h17": "h17 (Summer Peak)",
}

# Series colours in order, and the colour of values without a style.
SERIES_COLORS = (
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf",
    "#aec7e8", "#ffbb78", "#98df8a", "#ff9896", "#c5b0d5", "#c49c94", "#f7b6d2", "#c7c7c7", "#dbdb8d", "#9edae5",
)
UNSTYLED_COLOR = "#ff69b4"


# ---- top-N ---------------------------------------------------------------------------

def top_n_series(df: DataFrame, series: str, y: str, n: int, other: str = "Other") -> DataFrame:
    """Keep the ``n`` series largest by sum of absolute ``y``; rename the rest.

    Runs before aggregation.  Ties go to the smaller name.  The ranked list has at
    most ``n`` rows, so it is broadcast unless ``n`` itself is large.
    """
    top = (df.groupBy(series).agg(F.sum(F.abs(F.col(y))).alias("__w"))
             .orderBy(F.col("__w").desc(), F.col(series)).limit(n)
             .select(F.col(series).alias("__top")))
    if n <= MAX_BROADCAST_SERIES:
        top = F.broadcast(top)
    joined = df.join(top, F.col(series).eqNullSafe(F.col("__top")), "left")
    named = F.when(F.col("__top").isNull(), F.lit(other)).otherwise(F.col(series).cast("string"))
    return joined.withColumn(series, named).select(*df.columns)


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; pruned to ``n`` per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


# ---- orders --------------------------------------------------------------------------

def order_rank(column: str, order: list) -> Column:
    """Position in a custom order list (1-based); unlisted values come last."""
    at = F.array_position(F.array(*[F.lit(str(v)) for v in order]), F.col(column).cast("string"))
    return F.when(at == 0, F.lit(len(order) + 1)).otherwise(at).cast("int")


def sort_rows(df: DataFrame, keys: list[str], orders: dict[str, list] | None = None,
              strip_zeros: bool = True) -> DataFrame:
    """Sort by keys, with custom orders where given; then drop leading zeros of text keys."""
    orders = orders or {}
    by = []
    for k in keys:
        if orders.get(k):
            by.append(order_rank(k, orders[k]))
        by.append(F.col(k))
    out = df.orderBy(*by)
    kinds = dict(df.dtypes)
    plain = [k for k in keys if kinds[k] == "string" and not orders.get(k)] if strip_zeros else []
    return out.withColumns({k: S.strip_leading_zeros(k) for k in plain}) if plain else out


def _short_table(df: DataFrame) -> list:
    """All rows of a table that is written by hand; anything longer is an error."""
    rows = df.limit(MAX_STYLE_ROWS + 1).collect()
    if len(rows) > MAX_STYLE_ROWS:
        raise ValueError(f"style table has more than {MAX_STYLE_ROWS} rows")
    return rows


def style_orders(style: DataFrame) -> tuple[list, dict]:
    """Order list and colours of a style table ``order, color`` (a short file)."""
    rows = _short_table(style)
    has_color = "color" in style.columns
    return [r["order"] for r in rows], {r["order"]: r["color"] for r in rows} if has_color else {}


def custom_styles(styles: DataFrame) -> tuple[dict, dict]:
    """Orders and colours per column of a ragged style sheet; blanks are skipped."""
    rows = _short_table(styles)
    orders, colors = {}, {}
    for c in styles.columns:
        if c.endswith("_custom_colors"):
            continue
        orders[c] = [r[c] for r in rows if r[c] is not None]
        tint = f"{c}_custom_colors"
        if tint in styles.columns:
            colors[c] = dict(zip(orders[c], [r[tint] for r in rows if r[tint] is not None]))
    return orders, colors


def styled_values(df: DataFrame, column: str, style: DataFrame, seq: str) -> DataFrame:
    """Distinct values of a column with position and colour of the style table.

    Values the table does not list follow at the end in the default colour.
    """
    listed = style.select(F.col("order").alias(column), F.col(seq).alias("__s"), "color")
    return (df.select(column).distinct().join(listed, column, "left")
              .select(column, F.col("__s").isNull().cast("int").alias("unlisted"),
                      F.coalesce("__s", F.lit(0)).alias("position"),
                      F.coalesce("color", F.lit(UNSTYLED_COLOR)).alias("color")))


def sort_timeslices(df: DataFrame, column: str | None = None) -> DataFrame:
    """Label the 17 standard slices, or zero-pad the numbers of longer sets and sort."""
    column = column or ("timeslice" if "timeslice" in df.columns else "h")
    few = df.select(column).distinct().limit(len(TIMESLICE_LABELS) + 1).count() <= len(TIMESLICE_LABELS)
    if few:
        table = F.create_map(*[F.lit(v) for pair in TIMESLICE_LABELS.items() for v in pair])
        return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
    return df.withColumn(column, padded_slice(column)).orderBy(column)


def padded_slice(column: str) -> Column:
    """``h12`` becomes ``000012``; anything else stays."""
    digits = F.substring(F.col(column), 2, 100).try_cast("int")
    return F.when(digits.isNull(), F.col(column)).otherwise(S.zero_pad(digits, 6))


# ---- map bins ------------------------------------------------------------------------

def breakpoint_table(df: DataFrame, y: str, bins: int) -> DataFrame:
    """Equal-number breakpoints: one row, columns ``bp_0 ..``, taken from the sorted distinct values."""
    ranks = {f"bp_{i}": (lambda n, i=i: F.floor(F.lit(i + 1) * ((n - 1) / F.lit(bins)))) for i in range(bins - 1)}
    return ordered.values_at_ranks(df, y, [], ranks, distinct=True).drop("n")


def breakpoints(df: DataFrame, y: str, method: str = "equal number", bins: int = 9,
                lo: float | None = None, hi: float | None = None, manual: str | list | None = None) -> list[float]:
    """Bin edges of a map as a short driver-side list."""
    if method == "manual":
        items = manual.split(",") if isinstance(manual, str) else manual
        return [float(v) for v in items]
    if method == "equal number":
        row = breakpoint_table(df, y, bins).first()
        return [float(v) for v in row]
    if method != "equal width":
        raise ValueError(f"unknown binning {method!r}")
    if lo is not None and hi is not None:
        width = (hi - lo) / (bins - 2)
        return [lo + width * i for i in range(bins - 1)]
    row = df.agg(F.min(y).cast("double"), F.max(y).cast("double")).first()
    width = (row[1] - row[0]) / bins
    return [row[0] + width + width * i for i in range(bins - 1)]


def bin_index(y, breaks: list[float]) -> Column:
    """Number of breakpoints strictly below the value."""
    y = S.col(y)
    out = F.lit(0)
    for b in breaks:
        out = out + (y > F.lit(b)).cast("int")
    return out


def assign_bins(df: DataFrame, y: str, breaks: list[float], out: str = "bin_index") -> DataFrame:
    return df.withColumn(out, bin_index(y, breaks))


def bin_labels(breaks: list[float], manual: bool = False) -> list[str]:
    """Legend texts of the bins."""
    t = [str(b) if manual else S.short_number_text(b) for b in breaks]
    return [f"<= {t[0]}", *[f"{a} - {b}" for a, b in zip(t, t[1:])], f"> {t[-1]}"]


def label_bins(df: DataFrame, index: str, breaks: list[float], out: str = "bin_label", manual: bool = False) -> DataFrame:
    labels = F.array(*[F.lit(v) for v in bin_labels(breaks, manual)])
    return df.withColumn(out, F.get(labels, F.col(index)))
