"""Device stocks, efficiencies, technology options and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import joins, project

AREA = "ba"


def area_name(c: str = AREA) -> Column:
    return F.concat(F.lit("p"), F.col(c).cast("string")).alias(c)


def retirement(base: DataFrame, first: int, last: int) -> DataFrame:
    """Retired share of the base stock per year from its Weibull parameters."""
    d = joins.expand_years(base, first, last)
    return d.withColumn("retired", S.weibull_cdf(F.col("year") - F.lit(first - 1), "shape", "scale"))


def remaining_stock(stock: DataFrame, retired: DataFrame, shares: DataFrame, by: list[str]) -> DataFrame:
    """Base stock left per year, spread over the areas (and groups) of its division.

    ``stock``: keys and ``total``; ``retired``: keys, ``year``, ``retired``.
    """
    d = joins.natural_join(stock, retired, "inner").withColumn("left", F.col("total") * (F.lit(1.0) - F.col("retired")))
    d = d.groupBy("div", "year", *by).agg(F.sum("left").alias("left"))
    return (joins.natural_join(d, shares, "inner")
            .withColumn("left", F.col("left") * F.col("share")).withColumn(AREA, area_name()).drop("share", "div"))


def total_devices(stock: DataFrame, shares: DataFrame, by: list[str], single=("MSC", "FUF", "SCH")) -> DataFrame:
    """Devices per area and group; end uses without countable devices get one."""
    d = stock.groupBy("div", "year", *by).agg(F.sum("total").alias("total"))
    d = joins.natural_join(d, shares, "inner").withColumn("total", F.col("total") * F.col("share"))
    d = d.withColumn("total", F.when(F.col("use").isin(*single), F.lit(1.0)).otherwise(F.col("total")))
    return d.withColumn(AREA, area_name()).drop("share", "div")


def convert_units(df: DataFrame, value: str, unit: str, factors: dict[tuple, float]) -> DataFrame:
    """Multiply by the factor of the row's unit; other units stay."""
    return project.update_where(df, value, [(F.col(unit).isin(*units), F.col(value) * F.lit(f))
                                            for units, f in factors.items()])


# Unit factors of efficiency tables.
AVERAGE_UNITS = {("HSPF", "SEER", "EER"): 1 / S.BTU_PER_WH, ("watts",): 1 / (S.BTU_PER_WH * S.HOURS_PER_YEAR)}
SERVICE_UNITS = {("lumens",): 1 / (S.BTU_PER_WH * S.HOURS_PER_YEAR), ("cycles", "generic"): 1e3 * S.BTU_PER_WH}


def service_demand(use: DataFrame, average: DataFrame, base: DataFrame, base_year: int,
                   relative=("cycles", "generic"), plain=("Other", "FF", "SH")) -> DataFrame:
    """Service per row: energy times the efficiency that applies to its year and unit.

    ``use``: ..., ``year, use, serv_units, energy``; ``average`` and ``base`` bring
    ``avg_eff`` and ``base_eff``.
    """
    d = joins.natural_join(joins.natural_join(use, average, "left"), base, "left")
    later = F.col("year") > base_year
    eff = F.when(later, F.col("avg_eff")).when(F.col("year") == base_year, F.col("base_eff"))
    scaled = F.when(later, S.ratio("base_eff", "avg_eff")).when(F.col("year") == base_year, F.lit(1.0))
    eff = F.when(F.col("serv_units").isin(*relative), scaled).otherwise(eff)
    eff = F.when(F.col("use").isin(*plain), F.lit(1.0)).otherwise(eff)
    return d.withColumn("service", F.col("energy") * eff)


def reference_efficiency(service: DataFrame, by: list[str], after: int) -> DataFrame:
    """Service over energy after the base year; no consumption counts as one."""
    d = service.filter(F.col("year") > after).groupBy("div", "year", *by).agg(
        F.sum("energy").alias("energy"), F.sum("service").alias("service"))
    return d.withColumn("ref_eff", F.coalesce(S.ratio("service", "energy"), F.lit(1.0)))


def technology_options(options: DataFrame, areas: DataFrame, first: int, last: int) -> DataFrame:
    """Options of electric devices for every year on offer and every area of their division."""
    modelled = options.filter((F.col("fuel") == "EL") & F.col("device").isNotNull())
    relative = F.col("serv_units").isin("cycles", "generic")
    d = modelled.withColumn("eff", F.when(relative, S.ratio("base_eff", "eff")).otherwise(F.col("eff")))
    d = joins.within_years(d, "first_year", "last_year", first, last)
    return d.join(areas.select("div", "ba").distinct(), "div", "inner")


def without_unmodelled(df: DataFrame) -> DataFrame:
    """Drop electric equipment that has no model class."""
    return df.filter(~((F.col("fuel") == "EL") & F.col("device").isNull()))


def survival_rates(options: DataFrame, first_vintage: int) -> DataFrame:
    """Share of each vintage still in use per year; under a thousandth counts as none."""
    d = joins.expand_years(options, F.lit(first_vintage), F.col("year"), "vintage")
    return d.withColumn("survival", S.survival(F.col("year") - F.col("vintage"), "shape", "scale"))


def new_purchases(stock: DataFrame, by: list[str], shape: str = "shape", scale: str = "scale") -> DataFrame:
    """Purchases per year that keep the stock: this year's stock less what survives of earlier purchases.

    ``stock``: keys, ``year``, ``stock`` and the Weibull parameters.  A group holds one
    value per calendar year, so its year-ordered list is short; the recurrence folds over it.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("year"), F.col("stock").cast("double").alias("stock"),
                                                F.col(shape).cast("double").alias("k"), F.col(scale).cast("double").alias("s"))))
    packed = stock.groupBy(*by).agg(rows.alias("__r"))
    empty = F.array().cast("array<struct<year:int,buy:double>>")

    def step(done, row):
        def surviving(acc, past):
            age = (row["year"] - past["year"]).cast("double")
            left = F.exp(-F.pow(age / row["s"], row["k"]))
            return acc + past["buy"] * F.when(left < 0.001, F.lit(0.0)).otherwise(left)
        old = F.aggregate(done, F.lit(0.0), surviving)
        return F.concat(done, F.array(F.struct(row["year"].cast("int").alias("year"), (row["stock"] - old).alias("buy"))))

    bought = packed.withColumn("__b", F.aggregate("__r", empty, step))
    return bought.select(*by, F.inline("__b")).withColumnRenamed("buy", "purchases")
