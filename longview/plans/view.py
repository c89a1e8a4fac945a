"""A view: one declarative spec over a long table gives one lazy DataFrame."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.operators import aggregate as agg
from longview.operators import custom, prep, project, ranking
from longview.operators.common import numeric_columns
from longview.operators.compare import CONSECUTIVE, TOTAL, compare

# Setting names and choices of a view.
HISTOGRAM_X = "histogram_x"
STACKED = ("Bar", "Area")
WITHIN, BETWEEN = "Within Series", "Between Series"
COLUMN_ROLES = ("x", "y", "x_group", "series", "explode", "explode_group")


@dataclass(frozen=True)
class ViewSpec:
    """Settings of a view.  ``None`` (or the text ``"None"``) leaves a role empty."""
    x: str | None = None
    y: str | None = None
    y_b: str | None = None
    y_c: str | None = None
    y_agg: str | None = "sum(a)"
    x_group: str | None = None
    series: str | None = None
    series_limit: str | int = "All"
    explode: str | None = None
    explode_group: str | None = None
    chart_type: str = "Dot"
    range: str = "No"
    range_show_glyphs: str = "Yes"
    adv_op: str | None = None
    adv_col: str | None = None
    adv_col_base: str | None = None
    adv_op2: str | None = None
    adv_col2: str | None = None
    adv_col_base2: str | None = None
    adv_op3: str | None = None
    adv_col3: str | None = None
    adv_col_base3: str | None = None
    filter: dict = field(default_factory=dict)
    x_scale: str | float = 1
    y_scale: str | float = 1
    x_min: str | float = ""
    x_max: str | float = ""
    y_min: str | float = ""
    y_max: str | float = ""
    sync_axes: str = "Yes"
    sort_data: str = "Yes"
    cum_sort: str | None = None
    net_levels: str = "Yes"
    hist_num_bins: str | int = 20
    hist_weight: str = "Yes"
    bar_width: str | float = 0.8
    map_bin: str = "Auto Equal Num"
    map_num: str | int = 9
    map_nozeros: str = "Yes"
    map_min: str | float = ""
    map_max: str | float = ""
    map_manual: str = ""
    map_arrows: str = "No"
    map_arrow_loc: str | float = 0.8

    @classmethod
    def from_dict(cls, settings: dict) -> "ViewSpec":
        """Known settings of a dict; drawing settings are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: None if v == "None" else v for k, v in settings.items() if k in known})

    @classmethod
    def from_json(cls, text: str) -> "ViewSpec":
        return cls.from_dict(json.loads(text))

    def non_defaults(self) -> dict:
        """Settings that differ from an empty view."""
        plain = asdict(ViewSpec())
        return {k: v for k, v in asdict(self).items() if v != plain[k]}

    def to_json(self) -> str:
        return json.dumps(self.non_defaults(), sort_keys=True)

    @property
    def keys(self) -> list[str]:
        """Grouping columns in display order."""
        roles = [self.explode_group, self.explode, self.series, self.x_group, self.x]
        return [c for c in roles if c is not None]

    @property
    def steps(self) -> list[tuple]:
        """The comparison steps that are fully given."""
        raw = [(self.adv_op, self.adv_col, self.adv_col_base), (self.adv_op2, self.adv_col2, self.adv_col_base2),
               (self.adv_op3, self.adv_col3, self.adv_col_base3)]
        return [s for s in raw if None not in s]

    @property
    def arrows(self) -> bool:
        return self.chart_type == "Line Map" and self.map_arrows == "Yes"


def validate(spec: ViewSpec, roles: dict[str, list[str]], base_values: dict[str, list] | None = None) -> list[str]:
    """Problems of a spec against the column roles of its source; empty if it is fine.

    ``base_values`` optionally lists the values a comparison column can take.
    """
    problems = []
    for role in ("x", "y"):
        if getattr(spec, role) is None:
            problems.append(f"{role} is required")
    used: dict[str, str] = {}
    for role in COLUMN_ROLES:
        c = getattr(spec, role)
        if c is None:
            continue
        if c in used:
            problems.append(f"{c} fills both {used[c]} and {role}")
        used[c] = role
        allowed = {"x": [*roles["x-axis"], HISTOGRAM_X], "y": roles["y-axis"]}.get(role, roles["seriesable"])
        if c not in allowed:
            problems.append(f"{c} cannot be used as {role}")
    if spec.y_agg is not None and spec.y_agg not in agg.AGGREGATIONS and custom.registered(spec.y_agg) is None:
        problems.append(f"unknown aggregation {spec.y_agg}")
    for op, col, base in spec.steps:
        if op not in ("Difference", "Ratio"):
            problems.append(f"unknown operation {op}")
        if col not in roles["all"] and col != HISTOGRAM_X:
            problems.append(f"{col} is not a column")
        known = (base_values or {}).get(col)
        if known is not None and base not in (CONSECUTIVE, TOTAL) and str(base) not in {str(v) for v in known}:
            problems.append(f"{base} is not a value of {col}")
    return problems


def base_options(df: DataFrame, column: str) -> DataFrame:
    """Values a comparison on ``column`` can use as base, the two special ones first."""
    special = df.sparkSession.createDataFrame([(0, CONSECUTIVE), (1, TOTAL)], "position int, base string")
    values = df.select(F.col(column).cast("string").alias("base")).distinct()
    return special.unionByName(values.select(F.lit(2).alias("position"), "base"))


def unknown_bases(wanted: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """``wanted`` (column ``value``) with ``unknown``: whether a comparison on ``column`` of ``df`` has no such base."""
    known = base_options(df, column).select(F.col("base").alias("__base"), F.lit(False).alias("__new")).distinct()
    return wanted.join(known, F.col("value") == F.col("__base"), "left").select(*wanted.columns, F.coalesce("__new", F.lit(True)).alias("unknown"))


def run_view(df: DataFrame, spec: ViewSpec | dict, orders: dict[str, list] | None = None,
             sort: bool = True) -> DataFrame:
    """Filter, limit series, aggregate, compare, scale, add levels, sort.

    The result is one lazy plan; ``sort=False`` leaves out the final global sort for
    callers that write or aggregate further.
    """
    spec = ViewSpec.from_dict(spec) if isinstance(spec, dict) else spec
    for role in ("x", "y"):
        if getattr(spec, role) is None:
            raise ValueError(f"{role} is required")
    orders = orders or {}
    x, y, series = spec.x, spec.y, spec.series
    numeric = numeric_columns(df)
    aggregated = y in numeric and spec.y_agg is not None and x != HISTOGRAM_X

    used = list(dict.fromkeys([*spec.keys, y, *[c for c in (spec.y_b, spec.y_c) if c], *spec.filter]))
    # Only the columns of the view are read; without aggregation rows stay whole.
    d = df.select(*[c for c in used if c in df.columns]) if aggregated or x == HISTOGRAM_X else df
    d = project.apply_filters(d, spec.filter)

    limited = series is not None and str(spec.series_limit).isdigit()
    if limited and not aggregated:
        d = ranking.top_n_series(d, series, y, int(spec.series_limit))

    extra = []
    if aggregated:
        within = spec.range == WITHIN
        how = (spec.keys, spec.y_agg, y, spec.y_b, spec.y_c, within)
        d = agg.aggregate_top(d, *how, series, int(spec.series_limit)) if limited else agg.aggregate(d, *how)
        extra = ["range_min", "range_max"] if within else []
    elif x == HISTOGRAM_X:
        by = [c for c in spec.keys if c != HISTOGRAM_X]
        d = agg.histogram(d, y, int(spec.hist_num_bins), by, spec.hist_weight == "Yes", spec.sync_axes == "Yes")

    if spec.range == "No" and spec.y_agg is not None and y in numeric:
        for op, col, base in spec.steps:
            if col in d.columns:
                if base not in (CONSECUTIVE, TOTAL) and col in numeric_columns(d):
                    base = float(base)
                d = compare(d, op, col, base, y)

    if spec.arrows:
        d = project.flip_flows(d, x, y)
    if str(spec.x_scale) not in ("", "1") and x in numeric_columns(d):
        d = project.scale(d, x, float(spec.x_scale))
    if str(spec.y_scale) not in ("", "1") and y in numeric_columns(d):
        d = project.scale(d, y, float(spec.y_scale))

    sort_keys = spec.keys if spec.sort_data == "Yes" else []
    level_keys = [c for c in spec.keys if c != series]
    cumulative = spec.cum_sort in ("Ascending", "Descending")
    if cumulative:
        d = prep.cumulative_key(d, y, level_keys, spec.cum_sort == "Descending")
    if spec.net_levels == "Yes" and spec.chart_type in STACKED:
        d = prep.net_level(d, y, level_keys)
        extra = [*extra, f"Net Level {y}"]
    if sort and sort_keys:
        at = len([c for c in (spec.explode_group, spec.explode) if c is not None])
        by = [*sort_keys[:at], *(["y_cumulative"] if cumulative else []), *sort_keys[at:]]
        d = ranking.sort_rows(d, by, orders)
    if cumulative:
        d = d.drop("y_cumulative")
    return project.order_columns(d, sort_keys, y, extra)


def map_view(df: DataFrame, spec: ViewSpec | dict) -> tuple[DataFrame, list[float], list[str]]:
    """Map data of a view: rows with bin index and label, plus breakpoints and labels."""
    spec = ViewSpec.from_dict(spec) if isinstance(spec, dict) else spec
    d = run_view(df, spec, sort=False)
    if spec.map_nozeros == "Yes":
        d = project.drop_zeros(d, spec.y)
    method = {"Auto Equal Num": "equal number", "Auto Equal Width": "equal width", "Manual": "manual"}[spec.map_bin]
    limits = [float(v) if v != "" else None for v in (spec.map_min, spec.map_max)]
    breaks = ranking.breakpoints(d, spec.y, method, int(spec.map_num), *limits, manual=spec.map_manual)
    manual = method == "manual"
    d = ranking.label_bins(ranking.assign_bins(d, spec.y, breaks), "bin_index", breaks, manual=manual)
    return d, breaks, ranking.bin_labels(breaks, manual)


def chart_view(df: DataFrame, spec: ViewSpec | dict, orders: dict[str, list] | None = None) -> DataFrame:
    """Chart data of a view: stacked levels for stacked types, box statistics or ranges otherwise."""
    spec = ViewSpec.from_dict(spec) if isinstance(spec, dict) else spec
    d = run_view(df, spec, orders, sort=False)
    by = [c for c in (spec.explode_group, spec.explode) if c is not None]
    x = [c for c in (spec.x_group, spec.x) if c is not None]
    if spec.range == "Boxplot":
        return prep.boxplot_stats(d, [*by, *([spec.series] if spec.series else []), *x], spec.y)
    if spec.series is not None and spec.chart_type in STACKED:
        return prep.stack_levels(d, spec.x, spec.y, spec.series, [*by, *x[:-1]], (orders or {}).get(spec.series))
    if spec.series is not None and spec.range == BETWEEN:
        return prep.between_series_range(d, [*by, *x], spec.y)
    return d
