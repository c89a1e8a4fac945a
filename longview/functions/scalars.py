"""Scalar expressions shared by the operators and the ready-made pipelines.

Every function takes and returns Spark columns (or column names) unless it says
otherwise.  ANSI mode is assumed, so divisions and casts use their ``try_`` form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors.
HOURS_PER_YEAR = 8760
MWH_PER_FLAT_KW = 8.76
KM_PER_MILE = 1.60934
BTU_PER_WH = 3.41214
MMBTU_PER_MILLION_KWH = 3412.1416416
MWH_PER_MMBTU = 0.29329722222222
MILES_PER_DEGREE_LONG = 53
MILES_PER_DEGREE_LAT = 69

# Price level of each year relative to 2004.
DEFLATOR = {
    2004: 1.0, 2005: 0.967211529, 2006: 0.936857351, 2007: 0.910896792,
    2008: 0.877211857, 2009: 0.880345888, 2010: 0.866482174, 2011: 0.839614509,
    2012: 0.822345259, 2013: 0.810192373, 2014: 0.797433438, 2015: 0.796636802,
    2016: 0.786413427, 2017: 0.77023842, 2018: 0.752185957, 2019: 0.738886009,
    2020: 0.730124515, 2021: 0.697349107,
}


def col(c) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` in doubles; null where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def finite(c) -> Column:
    """Infinities and NaN become null."""
    c = col(c)
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(None)).otherwise(c)


def inflate(c, dollar_year: int = 2021, deflator=None) -> Column:
    """Restate money of the deflator's first year in ``dollar_year`` money."""
    return col(c) / F.lit(float((deflator or DEFLATOR)[dollar_year]))


def discount(c, year, rate: float = 0.05, base_year: int = 2022) -> Column:
    """Present value of ``c`` paid in ``year``."""
    return col(c) / F.pow(F.lit(1.0 + rate), col(year) - F.lit(base_year))


def capital_recovery_factor(rate: float, years: int) -> float:
    """Share of an investment due each year so that it is repaid after ``years``."""
    growth = (1 + rate) ** years
    return rate * growth / (growth - 1)


def weibull_cdf(t, shape, scale) -> Column:
    """Share of units retired by age ``t``."""
    return F.lit(1.0) - F.exp(-F.pow(ratio(t, scale), col(shape)))


def survival(age, shape, scale, floor: float = 0.001) -> Column:
    """Share of units still in service at ``age``; below ``floor`` counts as none."""
    left = F.exp(-F.pow(ratio(age, scale), col(shape)))
    return F.when(left < floor, F.lit(0.0)).otherwise(left)


def round_significant(c, digits: int = 3) -> Column:
    """Round to ``digits`` significant figures; zero stays zero."""
    c = col(c).cast("double")
    power = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    scaled = F.round(c * F.pow(F.lit(10.0), power)) / F.pow(F.lit(10.0), power)
    # The outer round removes the last-bit noise of scaling back.
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(scaled, 12))


def short_number(c) -> Column:
    """Label text: scientific outside [0.001, 100000), else three figures."""
    c = col(c).cast("double")
    plain = F.regexp_replace(round_significant(c, 3).cast("string"), r"\.0$", "")
    wide = (F.abs(c) < 0.001) | (F.abs(c) >= 100000)
    # Ties go to the even digit, so the mantissa is rounded before it is printed.
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))))
    even = F.when(c == 0, c).otherwise(F.bround(c / power, 2) * power)
    return F.when(wide, F.format_string("%.2E", even)).otherwise(plain)


def short_number_text(x: float) -> str:
    """Driver-side twin of :func:`short_number` for the few bin edges of a map."""
    if abs(x) < 0.001 or abs(x) >= 100000:
        return f"{x:.2E}"
    text = str(float(round(x, 2 - math.floor(math.log10(abs(x))))))
    return text.removesuffix(".0")


def strip_leading_zeros(c) -> Column:
    return F.ltrim(col(c), F.lit("0"))


def zero_pad(c, width: int) -> Column:
    """Left-fill with zeros without cutting longer text."""
    c = col(c).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def part(c, sep: str, i: int) -> Column:
    """The i-th piece (0-based) of a separated text; null when there is none."""
    return F.get(F.split(col(c), f"\\Q{sep}\\E"), F.lit(i))


def last_part(c, sep: str) -> Column:
    return F.substring_index(col(c), sep, -1)


def class_of(tech) -> Column:
    """``class_<suffix>`` for names with an underscore, else null."""
    tech = col(tech)
    return F.when(tech.contains("_"), F.concat(F.lit("class_"), last_part(tech, "_")))


def to_number(c) -> Column:
    """Text that is not a number becomes null."""
    return col(c).try_cast("double")


def replace_value(c, old, new) -> Column:
    c = col(c)
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def scale_where(c, condition: Column, factor: float) -> Column:
    c = col(c)
    return F.when(condition, c * F.lit(factor)).otherwise(c)


def planar(long, lat) -> tuple[Column, Column]:
    """Flat map coordinates in miles."""
    return (col(long) * F.lit(MILES_PER_DEGREE_LONG), col(lat) * F.lit(MILES_PER_DEGREE_LAT))


def along(start, end, fraction: float) -> Column:
    """The point ``fraction`` of the way from ``start`` to ``end``."""
    return col(start) + F.lit(fraction) * (col(end) - col(start))


def range_label(lo, hi, sep: str = " to ") -> Column:
    return F.concat(col(lo).cast("string"), F.lit(sep), col(hi).cast("string"))


def join_text(sep: str, *cols) -> Column:
    """Composite key text; null as soon as one piece is null."""
    pieces = []
    for i, c in enumerate(cols):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(col(c).cast("string"))
    return F.concat(*pieces)
