"""Shards of near-equal bytes by sampled splitters, with DataFrame operations only.

Keys are drawn with a chance in proportion to their size, quantiles of the draw are the boundaries of ranges, and
records go to ranges by key. Ranges that turn out overfull are subdivided by a second draw inside them. The exact
bytes and rows of all ranges then give every record its exact place in the global order, and shards are equal cuts
of that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import written

#: Ranges a shard at least, rows a range at most on average, keys drawn a range on average.
RANGES, RANGE_ROWS, DRAWN = 8, 1_000_000, 16
#: Equal texts stay together up to this share of a shard; larger groups may be cut.
WHOLE = 0.02


def _drawn(rows: DataFrame, mean_bytes: Column, salt: int) -> DataFrame:
    """A draw of ``rows``, each with a chance of size / mean_bytes; weight is what a drawn row stands for."""
    chance = F.col("size") / mean_bytes
    even = F.shiftrightunsigned(F.xxhash64("key", "id", "row", F.lit(salt)), 11) / float(2**53)
    return rows.filter(even < chance).withColumn("weight", F.greatest(chance, F.lit(1.0)))


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most ``key``, by a look at every s-th bound and then at s bounds."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    numbers = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    heads = numbers(bounds[::step])
    chunks = F.array(*[numbers(bounds[i:i + step]) for i in range(0, len(bounds), step)])
    head = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(chunks, F.greatest(head, F.lit(1))), lambda b: b <= key))
    return F.when(head == 0, 0).otherwise((head - 1) * step + inside)


def shards(docs: DataFrame, count: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes and 16), text_crc32, shard from 0, slot (from 0 in its shard).

    Sizes of shards differ from the mean by at most about the largest record or kept-together group. Records are
    ordered by the hash of their text, so equal texts are neighbours; groups of up to ``WHOLE`` of a shard's bytes stay
    in one shard, larger ones are cut by id. Null texts count as empty; null ids come first in their group and repeated
    rows get slots of their own. With fewer records than shards some shards are empty; an empty table gives no rows.

    Collected are splitters only (some per range) and totals of ranges; broadcast are tables bounded by the number of
    ranges or of hot texts (at most ``count / WHOLE``). A record is shuffled once by range, without its text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                               F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES * count, -(-n // RANGE_ROWS))
    per_range = max(1.0, total / ranges)

    # Texts that are too much for one shard to keep whole: fewer than count / WHOLE of them.
    hot = rows.groupBy("key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")).filter((F.col("_bytes") > total * WHOLE / count) & (F.col("_n") > 1))
    rows = rows.join(F.broadcast(hot.select("key", F.lit(True).alias("_hot"))), "key", "left")
    rows = rows.withColumn("place", F.struct("key", F.when(F.col("_hot"), F.col("id")).alias("id"), F.when(F.col("_hot"), F.col("row")).alias("row")))

    # First splitters: quantiles of a size-weighted draw of keys.
    drawn = _drawn(rows.select("key", "id", "row", "size"), F.lit(per_range / DRAWN), 1)
    so_far = F.sum("weight").over(Window.orderBy("key", "row"))
    cut = drawn.withColumn("cut", F.floor(so_far / F.sum("weight").over(Window.partitionBy(F.lit(1))) * ranges))
    bounds = sorted({r[0] for r in cut.groupBy("cut").agg(F.min("key")).collect()})
    rows = rows.withColumn("range", _below(bounds, F.col("key")))

    # Overfull ranges are subdivided by splitters of their own; all of them together need no more than `ranges`.
    full = rows.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * per_range)
    full = full.select("range", F.ceil(F.col("bytes") / per_range).alias("parts"))
    again = _drawn(rows.join(F.broadcast(full), "range"), F.lit(per_range / DRAWN), 2)
    in_range = Window.partitionBy("range")
    again = again.withColumn("cut", F.floor(F.sum("weight").over(in_range.orderBy("place")) / F.sum("weight").over(in_range) * F.col("parts")))
    splitters = again.groupBy("range", "cut").agg(F.min("place").alias("place")).groupBy("range").agg(F.sort_array(F.collect_list("place")).alias("bounds"))
    rows = rows.join(F.broadcast(splitters), "range", "left")
    rows = rows.withColumn("part", F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("place"))), F.lit(0)))
    rows = written(rows.withColumn("part", F.greatest("part", F.lit(0))).select("id", "size", "text_crc32", "place", "row", "range", "part"))

    # Exact places: what comes before in all ranges, and before in the own range.
    bins = rows.groupBy("range", "part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("range", "part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("base_bytes"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("base_rows"))
    own = Window.partitionBy("range", "part")
    rows = (rows.withColumn("_end", F.sum("size").over(own.orderBy("place")))  # with all of the same place
            .withColumn("_group", F.sum("size").over(Window.partitionBy("range", "part", "place")))
            .withColumn("_rank", F.row_number().over(own.orderBy("place", "id", "row")) - 1)
            .join(F.broadcast(bins), ["range", "part"]))
    middle = 2 * (F.col("base_bytes") + F.col("_end")) - F.col("_group")
    shard = F.least(F.lit(count - 1), F.floor(middle * count / F.lit(2.0 * max(1, total)))).cast("int")
    rows = written(rows.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("base_rows") + F.col("_rank")).alias("_rank")))
    first = rows.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return rows.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
