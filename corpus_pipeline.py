"""From documents to packed training sequences: toxicity, line dedup, near copies, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from longview.llm import stages
from longview.llm.common import ensure_checkpoint_dir

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("line_dedup", stages.drop_boilerplate),
    ("simhash", stages.one_of_near_copies),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: SQL can express neither the machine, the cube method nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
