"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and all but the last return the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longview.llm import line_dedup, mixing, packing, simhash, toxicity
from longview.llm.common import words_in


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the string-kernel machine scores 0.5 or more; it learns from the labelled ones of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.filter(toxicity.scored(F.col("text"), model) < 0.5)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts and counts the characters anew; all documents stay."""
    out = line_dedup.without_boilerplate(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.isnull("text"), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component (3-word shingles, 2 bits)."""
    return simhash.one_of_each(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it doesn't take go.

    Null texts are documents without words, a null source is a source, null ids take part. Rows that agree in all columns
    are documents of their own. Columns of any name come back; an empty table gives no rows.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", words_in(F.col("text")).alias("words"), F.xxhash64(*docs.columns).alias("hash"))
    number = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("hash"))  # tells repeated rows apart
    keyed = keyed.withColumn("number", number)
    taken = mixing.copies(keyed, F.col("words"), carry={"h": F.col("hash"), "n": F.col("number")})
    taken = taken.filter("copies > 0").select(F.col("doc_id").alias("id"), "h", "n", "copies")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")) & (F.col("number") == F.col("n"))
    return keyed.join(taken, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of all documents in sequences of at most 1024."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
