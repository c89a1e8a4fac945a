"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session may go without one; its temporary folder is removed when Python ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="longview-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = "file://" + _LOCAL[0]
    return base.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The name of a folder in it that nothing else uses."""
    return f"{shared_folder(spark)}/longview-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write an intermediate table once to the shared folder and read it from there.

    Cuts the lineage and survives the loss of executors; used where several inputs
    of one query come from the same pass over the facts.
    """
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for renames and small files that Spark has no reader or writer for."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
