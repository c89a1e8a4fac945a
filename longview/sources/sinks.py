"""Writing views, sources and report metadata."""

from __future__ import annotations

import datetime
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from longview.shared import hadoop_path

FORBIDDEN = r'[\\/:"*?<>|]'


def safe_name(name: str) -> str:
    """File-name form of a section title."""
    return re.sub(FORBIDDEN, "-", name)


def stamp(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime("%Y-%m-%d-%H-%M-%S")


def output_name(base: str, prefix: str = "", date: bool = False, now=None) -> str:
    """``[prefix-]base[-date]``."""
    return (f"{prefix}-" if prefix else "") + base + (f"-{stamp(now)}" if date else "")


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> str:
    """A table as CSV part files; an existing table is never overwritten silently."""
    df.write.mode(mode).option("header", header).csv(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "csv", header: bool = True) -> str:
    if fmt == "csv":
        return write_csv(df, path, header)
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def write_panels(df: DataFrame, path: str, explode: str, explode_group: str | None = None, fmt: str = "parquet") -> str:
    """One folder per panel of a view."""
    keys = [explode_group, explode] if explode_group else [explode]
    df.write.mode("errorifexists").partitionBy(*keys).format(fmt).save(path)
    return path


def write_marker(spark: SparkSession, path: str) -> None:
    """The marker that makes a folder a run."""
    spark.createDataFrame([("marker",)], "value string").coalesce(1).write.mode("overwrite").text(path)


def publish_runs(spark: SparkSession, staged: dict[str, str], out: str, column: str, marker: str) -> list[str]:
    """Move tables written by ``partitionBy(column)`` to ``<out>/<value>/<target>``, then write the markers.

    ``staged`` maps each written folder to the path of its table inside a run.  Nothing is copied, and a run gets its
    marker after all of its tables are in place, so one that is cut short never looks finished.  An existing table is
    an error before anything moves.
    """
    moves, runs = [], set()
    for folder, target in staged.items():
        fs, path = hadoop_path(spark, folder)
        for part in fs.listStatus(path):
            name = part.getPath().getName()
            if part.isDirectory() and name.startswith(f"{column}="):
                run = unquote(name.removeprefix(f"{column}="))
                runs.add(out if run == "." else f"{out}/{run}")
                to = f"{out if run == '.' else f'{out}/{run}'}/{target}"
                if fs.exists(hadoop_path(spark, to)[1]):
                    raise FileExistsError(to)
                moves.append((fs, part.getPath(), to))
    for fs, source, to in moves:
        _, path = hadoop_path(spark, to)
        fs.mkdirs(path.getParent())
        if not fs.rename(source, path):
            raise OSError(f"cannot move {source} to {to}")
    for run in sorted(runs):
        put_text(spark, f"{run}/{marker}", "marker\n")
    for folder in staged:
        fs, path = hadoop_path(spark, folder)
        fs.delete(path, True)
    return [to for _, _, to in moves]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: written beside its place and then renamed."""
    fs, to = hadoop_path(spark, path)
    _, beside = hadoop_path(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(to, True)
    if not fs.rename(beside, to):
        raise OSError(f"cannot write {path}")


def build_info(spark: SparkSession, sources: list[str], config: dict, now=None) -> DataFrame:
    """Build time, data sources and default settings of a report as a key-value table."""
    rows = [("Build date/time", stamp(now))]
    rows += [("Data Source", s) for s in sources]
    rows += [(str(k), str(v)) for k, v in config.items()]
    return spark.createDataFrame(rows, "item string, value string")
