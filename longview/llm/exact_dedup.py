"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level only decides which rows the next and dearer one has to look at. What a level passes on is a bitmap of the
keys that occurred at least twice. Its size is fixed, so it can be broadcast at any scale; two keys that share a bit
only cause a full hash that was not needed, never a wrong group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import SPACE, written

#: Words of 64 bits of a bitmap: 2**24 bits, at most 2**18 rows of two numbers.
BITMAP_WORDS = 2**18
#: Code points of the normalised text that the second level hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _word(*keys: str) -> Column:
    return F.xxhash64(*keys).bitwiseAND(BITMAP_WORDS - 1)


def _bit(*keys: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 58)


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmap (word, bits) of the key values that occur at least twice."""
    twice = rows.groupBy(*keys).count().filter("count > 1")
    bit = F.expr("shiftleft(1L, cast(bit AS int))")
    return (twice.select(_word(*keys).alias("word"), _bit(*keys).alias("bit"))
            .groupBy("word").agg(F.bit_or(bit).alias("bits")))


def _marked(rows: DataFrame, bitmap: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` with a boolean column: whether the bitmap has the row's key."""
    hit = F.expr("coalesce(shiftrightunsigned(bits, cast(_bit AS int)) & 1, 0) = 1")
    return (rows.withColumn("word", _word(*keys)).withColumn("_bit", _bit(*keys))
            .join(F.broadcast(bitmap), "word", "left").withColumn(name, hit).drop("word", "_bit", "bits"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the id that stays of its group, the size of the group, whether it stays.

    Texts are equal when they are identical after removal of ASCII white space. Of equal texts the row with the most
    code points stays, then the smallest id; null ids come last. Null texts count as empty texts and form one group.
    Of rows that agree in all of that exactly one stays. ``carry`` names expressions over ``docs`` that are evaluated
    while its texts are read and come back as further columns.
    An empty table gives an empty result; other columns of ``docs`` are not looked at, whatever their names.

    Two scans read the texts. The first keeps two numbers a row. The second computes the full hash, and only for rows
    whose length and prefix hash occur more than once. Only ids, numbers and hashes are shuffled, never texts; equal
    keys are counted before the shuffle and hot groups are split by the skew join.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"), normalised(text).alias("norm"),
                       F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (carry or {}).items()]).alias("carried"))
    seen = written(rows.select(F.length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix")))
    by_size = _marked(seen, _repeated(seen, "size"), "hit", "size").filter("hit").drop("hit")
    by_prefix = _repeated(by_size, "size", "prefix")
    rows = rows.withColumn("size", F.length("norm")).withColumn("prefix", F.xxhash64(F.substring("norm", 1, PREFIX)))
    rows = _marked(rows, by_prefix, "hit", "size", "prefix")
    rows = written(rows.select("id", "points", "carried", F.when(F.col("hit"), F.unhex(F.sha2("norm", 256))).alias("full"),
                               F.monotonically_increasing_id().alias("row")))
    again = rows.filter("full IS NOT NULL")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.isnull("id").alias("no_id"), F.col("id"), F.col("row"))).alias("best")
    groups = written(again.groupBy("full").agg(best, F.count("*").alias("n")).filter("n > 1"))
    one = F.col("n").isNull()
    out = again.join(groups, "full", "left").select(
        "id", F.when(one, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        (one | (F.col("row") == F.col("best.row"))).alias("kept"), "carried")
    alone = rows.filter("full IS NULL").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "carried")
    return out.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", *[F.col(f"carried.{k}") for k in carry or {}])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, carry={"text_sha256": F.sha2(normalised(F.col("text")), 256)})


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
