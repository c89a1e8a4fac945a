"""Retail prices and adders by sector and area; comparison of demand sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate, joins, reshape

SECTORS = ("res", "com", "ind")


def market_of_area(overlap: DataFrame) -> DataFrame:
    """Market region with the largest overlap of each area (ties kept)."""
    named = overlap.filter((F.col("ba") != "") & (F.col("market") != ""))
    return aggregate.argmax_rows(named, ["ba"], "area").select("ba", "market")


def retail_prices(prices: DataFrame, sales: DataFrame, geo: DataFrame, markets: DataFrame,
                  adders: DataFrame, year: int) -> DataFrame:
    """Price and adder over the generation price by sector and area (per MWh).

    ``prices``: ``state, res, com, ind``; ``sales``: ``state, res_sales, com_sales, ind_sales``;
    ``adders``: ``market, category, year, adder`` summed over categories.
    """
    adder = adders.filter(F.col("year") == year).groupBy("market").agg(F.sum("adder").alias("avg_adder"))
    d = joins.natural_join(prices, sales, "inner")
    d = joins.natural_join(d, geo.select("ba", "state").distinct(), "inner")
    d = joins.natural_join(joins.natural_join(d, markets, "inner"), adder, "inner")
    paid = sold = None
    for s in SECTORS:
        one = F.col(s) * F.col(f"{s}_sales")
        paid = one if paid is None else paid + one
        sold = F.col(f"{s}_sales") if sold is None else sold + F.col(f"{s}_sales")
    d = d.withColumn("__gen", S.ratio(paid, F.col("avg_adder") * sold))
    items = F.array(*[F.struct(F.lit(s).alias("sector"), (F.col(s) * 10).alias("price"),
                               ((F.col(s) - F.col("__gen")) * 10).alias("adder")) for s in SECTORS])
    return d.select("ba", F.inline(items)).select("sector", "ba", "price", "adder")


def compare_sources(use: DataFrame, published: DataFrame, key: str, excluded, labels: dict[str, str]) -> DataFrame:
    """Totals with and without the excluded rows beside a published series, in long form."""
    d = use.groupBy("year", key).agg(F.sum("value").alias("all_rows"),
                                     aggregate.filtered_sum("value", ~excluded).alias("without_excluded"))
    d = joins.natural_join(d, published, "inner")
    long = reshape.melt(d, ["year", key], ["all_rows", "without_excluded", "published"], "source", "value")
    return joins.map_values(long, "source", labels)
