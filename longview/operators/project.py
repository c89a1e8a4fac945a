"""Filters, projections, column roles and value clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.functions import scalars as S
from longview.operators.common import BLANK, numeric_columns, string_columns


# ---- filters -------------------------------------------------------------------------

def filter_condition(df: DataFrame, column: str, wanted) -> Column:
    """Condition for one filter entry: a list, ``"last"`` or a start/end/exclude dict."""
    c = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(wanted, str):
        if wanted != "last":
            raise ValueError(f"unknown filter keyword {wanted!r}")
        # A one-row subquery: evaluated once, usable for partition pruning.
        return c == df.agg(F.max(column)).scalar()
    if isinstance(wanted, dict):
        cond = F.lit(True)
        if "start" in wanted:
            cond = c >= F.lit(wanted["start"]).cast(kind)
        if "end" in wanted and "start" in wanted:
            cond = cond & (c <= F.lit(wanted["end"]).cast(kind))
        if wanted.get("exclude"):
            cond = cond & ~c.isin(*[F.lit(v).try_cast(kind) for v in wanted["exclude"]])
        return cond
    values = list(wanted)
    if not values:
        return F.lit(False)
    return c.isin(*[F.lit(v).try_cast(kind) for v in values])


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """AND of all filter entries.  ``"last"`` refers to the unfiltered source."""
    cond = None
    for column, wanted in filters.items():
        if column not in df.columns:
            continue
        one = filter_condition(df, column, wanted)
        cond = one if cond is None else cond & one
    return df if cond is None else df.filter(cond)


# ---- column choice -------------------------------------------------------------------

def keep_for_grouping(df: DataFrame, group_cols, val_cols=None, drop_cols=None) -> DataFrame:
    """Columns left for a roll-up: keys plus values, or everything but ``drop_cols``."""
    if val_cols is not None:
        keep = set(group_cols) | set(val_cols)
        return df.select(*[c for c in df.columns if c in keep])
    return df.drop(*(drop_cols or []))


def order_columns(df: DataFrame, sort_cols, y: str, extra=()) -> DataFrame:
    """Other columns first, then sort columns, y and the extra level columns."""
    tail = [*sort_cols, y, *extra]
    return df.select(*[c for c in df.columns if c not in tail], *[c for c in tail if c in df.columns])


def rename_all(df: DataFrame, names) -> DataFrame:
    """Positional rename of every column."""
    return df.toDF(*names)


# ---- scaling and conditional updates -------------------------------------------------

def scale(df: DataFrame, column: str, factor: float, by: str | None = None, vals=None) -> DataFrame:
    if by is None:
        return df.withColumn(column, F.col(column) * F.lit(factor))
    return df.withColumn(column, S.scale_where(column, F.col(by).isin(list(vals)), factor))


def update_where(df: DataFrame, column: str, cases: list[tuple[Column, Column]]) -> DataFrame:
    """Sequential conditional updates of one column; a later match wins.

    Every new value may refer to the old value of the column.
    """
    out = F.col(column) if column in df.columns else F.lit(None)
    for cond, value in cases:
        out = F.when(cond, value).otherwise(out)
    return df.withColumn(column, out)


def flip_flows(df: DataFrame, pair: str, y: str) -> DataFrame:
    """Turn negative flows ``a-b`` into positive flows ``b-a``."""
    turned = F.concat(S.part(pair, "-", 1), F.lit("-"), S.part(pair, "-", 0))
    return (df.withColumn(pair, F.when(F.col(y) < 0, turned).otherwise(F.col(pair)))
              .withColumn(y, F.abs(F.col(y))))


def drop_flat(df: DataFrame, height: str, eps: float = 1e-13) -> DataFrame:
    """Remove segments too low to draw."""
    return df.filter(F.abs(F.col(height)) > eps)


def drop_zeros(df: DataFrame, y: str) -> DataFrame:
    return df.filter(F.col(y) != 0)


def flag(df: DataFrame, name: str, cond: Column) -> DataFrame:
    """Yes/no column; an unknown condition counts as no."""
    return df.withColumn(name, F.when(cond, F.lit("yes")).otherwise(F.lit("no")))


def zero_last_year(df: DataFrame, y: str, year: str = "year") -> DataFrame:
    """Set ``y`` to zero in the last year present."""
    return df.withColumn(y, F.when(F.col(year) == df.agg(F.max(year)).scalar(), F.lit(0.0)).otherwise(F.col(y)))


def drop_region_prefix(df: DataFrame, column: str, prefix: str, rename_to: str) -> DataFrame:
    """Keep regions that do not carry ``prefix`` and give the column its new name."""
    return df.filter(~F.col(column).cast("string").startswith(prefix)).withColumnRenamed(column, rename_to)


def group_label(df: DataFrame, x_group: str, x: str, out: str | None = None) -> DataFrame:
    """Combined category text of a grouped x axis."""
    return df.withColumn(out or f"{x_group}_{x}", S.join_text(" ", x_group, x))


# ---- types, roles and fills ----------------------------------------------------------

def coerce_types(df: DataFrame, meta: dict) -> DataFrame:
    """Apply ``{"column": {"type": "number" | "string"}}``; bad numbers become null."""
    changes = {}
    for c in df.columns:
        kind = meta.get(c, {}).get("type")
        if kind == "number":
            changes[c] = S.to_number(F.col(c).cast("string")) if c in string_columns(df) else F.col(c)
        elif kind == "string":
            changes[c] = F.col(c).cast("string")
    return df.withColumns(changes) if changes else df


def lowercase_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.col(c)) for c in string_columns(df)})


def clean_sentinels(df: DataFrame, tokens=("Eps", "Undf"), convert: bool = True, keep=()) -> DataFrame:
    """Sentinel texts become 0; a text column turns numeric if every value parses, unless it is one to ``keep``.

    The all-or-nothing conversion changes the schema, so it costs one aggregate
    job over all text columns together.
    """
    texts = string_columns(df)
    if not texts:
        return df
    df = df.withColumns({c: F.when(F.col(c).isin(*tokens), F.lit("0")).otherwise(F.col(c)) for c in texts})
    texts = [c for c in texts if c not in keep]
    if not convert or not texts:
        return df
    checks = []
    for i, c in enumerate(texts):
        checks.append(F.count(F.col(c)).alias(f"n{i}"))
        checks.append(F.count(S.to_number(c)).alias(f"p{i}"))
    row = df.agg(*checks).first()
    numeric = [c for i, c in enumerate(texts) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"p{i}"]]
    return df.withColumns({c: S.to_number(c) for c in numeric}) if numeric else df


def column_roles(df: DataFrame, max_distinct: int = 500) -> dict[str, list[str]]:
    """Roles of the columns of an arbitrary table.

    Text is discrete, everything else continuous; discrete columns and
    non-float columns with few distinct values can be filtered and used as series.
    """
    return {**_base_roles(df), **_few_valued(df, max_distinct)}


def _base_roles(df: DataFrame) -> dict[str, list[str]]:
    discrete = string_columns(df)
    continuous = [c for c in df.columns if c not in discrete]
    return {"all": df.columns, "discrete": discrete, "continuous": continuous,
            "x-axis": df.columns, "y-axis": continuous}


def _few_valued(df: DataFrame, max_distinct: int) -> dict[str, list[str]]:
    whole = [f.name for f in df.schema.fields
             if not isinstance(f.dataType, (T.StringType, T.DoubleType, T.FloatType, T.DecimalType))]
    few = few_valued_columns(df, whole, max_distinct)
    usable = string_columns(df) + few
    return {"filterable": usable, "seriesable": usable}


def few_valued_columns(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    """Columns with fewer than ``limit`` distinct values (null counts as one).

    One job with sketches settles all clear cases; only columns whose estimate is
    near the limit are counted exactly.
    """
    if not columns:
        return []
    est = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(columns)],
                 *[F.max(F.col(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(columns)]).first()
    size = {c: (est[f"d{i}"] or 0) + (est[f"z{i}"] or 0) for i, c in enumerate(columns)}
    near = [c for c in columns if 0.8 * limit <= size[c] <= 1.2 * limit]
    for c in near:
        size[c] = df.select(c).distinct().limit(limit).count()
    return [c for c in columns if size[c] < limit]


def roles_from_meta(df: DataFrame, meta: dict) -> dict[str, list[str]]:
    """Roles driven by column metadata (``y-allow``, ``filterable``, ``seriesable``)."""
    base = _base_roles(df)
    discrete, continuous = base["discrete"], base["continuous"]

    def chosen(key: str) -> list[str]:
        return ([c for c in discrete if meta.get(c, {}).get(key) is not False]
                + [c for c in continuous if meta.get(c, {}).get(key) is True])

    y_axis = [c for c in continuous if meta.get(c, {}).get("y-allow") is not False]
    return {"all": df.columns, "discrete": discrete, "continuous": continuous,
            "y-axis": y_axis, "x-axis": [c for c in df.columns if c not in y_axis],
            "filterable": chosen("filterable"), "seriesable": chosen("seriesable")}


def fill_by_role(df: DataFrame) -> DataFrame:
    """Missing text becomes the blank marker, missing numbers zero."""
    texts, numbers = string_columns(df), numeric_columns(df)
    if texts:
        df = df.fillna(BLANK, subset=texts)
    if numbers:
        df = df.fillna(0, subset=numbers)
    return df
