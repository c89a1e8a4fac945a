"""Mixing sources to target weights by the cube method (balanced sampling).

Every document of a source may be taken r = target / size of the source times on average. The whole part of r is taken
for sure; the fraction is the document's inclusion probability. The flight phase moves probabilities through the null
space of two constraints, the number of documents and the number of words, so that both totals stay where they are
while all but two documents of a bucket end at 0 or 1. What is left of the buckets of a source flies on together, level
by level, until a small landing problem of a few documents a source remains.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import words_in, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document, and so a source, is taken at most so many times.
MOST = 3
#: Rows that one flight takes on average.
FLIGHT = 512
#: A probability nearer than this to 0 or 1 has arrived.
NEAR = 1e-9
#: Documents of a source that the landing settles together with what the flights leave.
LANDING = 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of ``sizes`` (source, size): number from 1, rows, source_size, target.

    Targets share the total by weight and stop at ``most`` times the source's size; what is beyond is shared among the
    others by weight, until no target is above. Sources are ordered by code point, null last. The table has one row a
    source, and its windows run over those rows.
    """
    everything = Window.partitionBy(F.lit(1))
    table = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    table = written(table)
    table = table.withColumn("number", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") - 1) % len(weights) + 1)
    table = table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # Sources reach their caps in the order of cap / weight; the share of a unit of weight is known at each of them.
    before = everything.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    taken, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("share", (total - taken) / (all_weight - used)).withColumn("total", total)
    table = table.withColumn("full", F.col("share") * F.col("weight") >= F.col("cap"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    unit = rest / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(unit * F.col("weight"))
    return table.select("source", "number", "rows", "source_size", target.alias("target"))


def fly(sizes: list[int], chances: list[float], seed: str, land: bool) -> list[float]:
    """Chances after the flight over units of one bucket, in the given order; at most two are left between 0 and 1.

    With ``land`` all are settled: a few units of all sizes stay out of the flight, and of all ways to settle them and
    what the flight leaves, the one nearest to the expected words and documents is taken.
    """
    n, draw, p, active = len(sizes), random.Random(seed), list(chances), []
    aside = {i * n // LANDING for i in range(LANDING)} if land else set()
    for k in range(n):
        if k in aside:
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = (sizes[i] for i in active)
        u = (c - b, a - c, b - a) if a != b or b != c else (1, -1, 0)
        steps = []
        for sign in (1, -1):
            steps.append(min((1 - p[i] if sign * d > 0 else p[i]) / abs(d) for i, d in zip(active, u) if d))
        step = steps[0] if draw.random() * (steps[0] + steps[1]) < steps[1] else -steps[1]
        for i, d in zip(active, u):
            p[i] += step * d
            p[i] = 0.0 if p[i] < NEAR else 1.0 if p[i] > 1 - NEAR else p[i]
        active = [i for i in active if 0 < p[i] < 1]
    if land and n:
        left = np.array(sorted({*aside, *active}))
        ways = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        size, chance = np.array([sizes[i] for i in left]), np.array([p[i] for i in left])
        off = np.abs(ways @ size - chance @ size) + np.abs(ways.sum(axis=1) - chance.sum())
        for i, v in zip(left, ways[off.argmin()]):
            p[i] = float(v)
    return p


def _flights(units: DataFrame, seed: int, level: int, land: bool) -> DataFrame:
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents fly first, so what is left in the end is small.
        pdf = pdf.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        name = f"{seed}/{level}/{pdf.number.iat[0]}/{pdf.bucket.iat[0]}"
        return pdf.assign(chance=fly(pdf["size"].tolist(), pdf.chance.tolist(), name, land))

    return units.groupBy("number", "bucket").applyInPandas(f, units.schema)


def copies(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
           seed: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies (0 to ``most``) and the carried columns.

    ``size`` is a whole number of words, null for none. Null sources are one source, the last; null ids take part, and
    repeated rows are documents of their own. Documents of size 0 count as documents and add no words. The choice
    depends on ids, sizes and ``seed`` alone, not on partitions, so that reruns agree. No rows, no rows.

    Only ids, sizes and numbers are shuffled. A bucket has some ``FLIGHT`` rows at any size of a source, and the
    number of levels grows with the logarithm of the rows.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                               *[c.alias(f"carry_{k}") for k, c in (carry or {}).items()], F.monotonically_increasing_id().alias("row")))
    targets = written(source_targets(rows.select("source", "size"), weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("ratio", ratio)
    rows = written(rows.drop("_source").withColumn("sure", F.floor(F.col("ratio") + NEAR)))
    units = rows.withColumn("chance", F.col("ratio") - F.col("sure")).filter(F.col("chance") > NEAR)
    units = units.select("row", "number", "size", F.xxhash64("id", "size", F.lit(seed)).alias("order"), "chance", "rows")
    settled, level = [], 0
    while True:
        land = (units.agg(F.max("rows")).first()[0] or 0) <= FLIGHT
        bucket = F.pmod(F.xxhash64("order", F.lit(level)), F.ceil(F.col("rows") / FLIGHT)).alias("bucket")
        flown = written(_flights(units.select("row", "number", "size", "order", "chance", bucket), seed, level, land))
        settled.append(flown.filter("chance = 0 OR chance = 1").select("row", "chance"))
        if land:
            break
        left = flown.filter("chance > 0 AND chance < 1").drop("bucket")
        rows_left = written(left.groupBy("number").agg(F.count("*").alias("rows")))
        units, level = left.join(rows_left, "number"), level + 1
    chosen = settled[0]
    for s in settled[1:]:
        chosen = chosen.union(s)
    out = rows.join(chosen, "row", "left").withColumn("copies", (F.col("sure") + F.coalesce("chance", F.lit(0.0))).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", *[F.col(f"carry_{k}").alias(k) for k in carry or {}])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs, words_in(F.col("text"))).withColumn("taken", F.col("copies") * F.col("size"))
