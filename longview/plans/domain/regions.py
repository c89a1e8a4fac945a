"""Region roll-ups and attribute joins of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.operators import aggregate, joins


def to_balancing_area(df: DataFrame, region_map: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rename resource regions (``rs``) to their area (``r``); others stay; optional roll-up.

    The column ``region`` becomes ``rb``.
    """
    table = region_map.select(F.col("rs").alias("raw"), F.col("r").alias("display"))
    out = joins.map_values(df, "region", table).withColumnRenamed("region", "rb")
    return aggregate.sum_over(out, by, drop_cols=[]) if by else out


def add_cooling_water(df: DataFrame, cooling: DataFrame) -> DataFrame:
    """Cooling technology and water source of each technology, with defaults."""
    table = joins.one_row_per_key(cooling.select(F.lower("tech").alias("tech"), "ctt", "wst"), "tech")
    return (df.join(table, "tech", "left")
              .withColumn("wst", F.coalesce("wst", F.lit("other")))
              .withColumn("ctt", F.coalesce("ctt", F.lit("none"))))
