"""CSV sources: files, directories, preambles, numbered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longview.sources.listing import files_below, headers_of, opened_by_tasks, qualified, with_headers


def split_paths(paths: str) -> list[str]:
    """Several sources are separated by a pipe."""
    return [p.strip().replace('"', "").rstrip("/") for p in paths.split("|") if p.strip()]


def tables_below(spark: SparkSession, root: str) -> DataFrame:
    """(name, table) of the CSV tables below ``root``: plain files, or folders of part files named like one."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    table = F.when(folder.endswith(".csv"), folder).otherwise(F.col("path"))
    return files_below(spark, root).select(table.alias("table")).distinct().select(F.regexp_extract("table", r"([^/]*)$", 1).alias("name"), "table")


def tables_of(spark: SparkSession, root: str, name: str) -> list[str]:
    """All tables of one name: one path a run."""
    return sorted(r[0] for r in tables_below(spark, root).filter(F.col("name") == name).select("table").collect())


def file_name(ext: str = "csv"):
    """Stem of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_name"), rf"(.*)\.{ext}$", 1)


def by_header(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The named files (or folders of part files) grouped by their header line, so that each group can be one scan."""
    groups: dict[str, list[str]] = {}
    for f, header in headers_of(spark, files).items():
        groups.setdefault(header, []).append(f)
    return groups


def _reader(spark: SparkSession, schema, infer: bool, header: bool = True):
    reader = spark.read.option("header", header)
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)


def folder_scans(spark: SparkSession, root: str, schema=None, infer: bool = True) -> list[DataFrame]:
    """The CSV files directly in a folder, one scan per header layout.

    Files of one layout, or with a ``schema``, are read as the folder itself, without a list of them. Only the files of a
    folder with several layouts are named one by one.
    """
    whole = lambda: _reader(spark, schema, infer).option("pathGlobFilter", "*.csv").csv(root)
    if schema is not None:
        return [whole()]
    files = files_below(spark, root, recursive=False)
    if not opened_by_tasks(qualified(spark, root)):
        groups = by_header(spark, sorted(r[0] for r in files.select("path").collect()))
        return [_reader(spark, schema, infer).csv(paths) for paths in groups.values()]
    headers = with_headers(files.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path"))
    layouts = headers.groupBy("header").count().orderBy("header").collect()
    if len(layouts) <= 1:
        return [whole()]
    paths = {r["header"]: [] for r in layouts}
    for r in headers.collect():
        paths[r["header"]].append(r["path"])
    return [_reader(spark, schema, infer).csv(sorted(p)) for p in paths.values()]


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan(spark: SparkSession, files: list[str], schema=None, infer: bool = True, extra: dict | None = None,
         header: bool = True) -> DataFrame:
    """One scan per header layout, united by column name.

    ``extra`` adds columns computed from file metadata.  With a ``schema`` no
    inference pass over the data is needed.
    """
    if schema is not None or not header:
        groups = {"": files}
    else:
        groups = by_header(spark, files)
    return united([_with_extra(_reader(spark, schema, infer, header).csv(paths), extra) for paths in groups.values()])


def _with_extra(df: DataFrame, extra: dict | None) -> DataFrame:
    return df.select("*", *[e.alias(n) for n, e in (extra or {}).items()])


def read_csv_source(spark: SparkSession, paths: str, schema=None, infer: bool = True) -> DataFrame:
    """Files and directories separated by ``|``, united by name.

    A directory contributes all its CSV files.  ``filename`` is added when a
    directory or more than one source is given.
    """
    entries = split_paths(paths)
    files = [e for e in entries if e.lower().endswith(".csv")]
    folders = [e for e in entries if e not in files]
    extra = {"filename": file_name()} if len(entries) > 1 or folders else None
    frames = [scan(spark, files, schema, infer, extra)] if files else []
    return united(frames + [_with_extra(df, extra) for f in folders for df in folder_scans(spark, f, schema, infer)])


def number_in_file(df: DataFrame, out: str) -> DataFrame:
    """1-based row number inside each file, for a frame straight from a scan.

    A row's place is known inside its task from the running id; the blocks of one
    file are lined up by their offsets, so no file is gathered in one task.
    """
    cols = df.columns
    d = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                  F.monotonically_increasing_id().alias("__id"))
    blocks = d.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    number = F.col("__id") - F.col("__first") + F.col("__before") + 1
    return d.join(blocks, ["__file", "__block"]).select(*cols, number.alias(out))


def read_with_preamble(spark: SparkSession, path: str, skip: int, schema=None) -> DataFrame:
    """CSV whose first ``skip`` lines are text, followed by a header line."""
    lines = number_in_file(spark.read.text(path), "__line")
    head = spark.read.text(path).limit(skip + 1).collect()[skip][0]
    names = [c.strip().strip('"') for c in head.split(",")]
    fields = schema or ", ".join(f"`{n}` STRING" for n in names)
    body = lines.filter((F.col("__line") > skip + 1) & (F.trim("value") != ""))
    return body.select(F.from_csv("value", fields).alias("r")).select("r.*")


def read_numbered(spark: SparkSession, root: str, order_col: str = "HourID", schema=None) -> DataFrame:
    """One file per key: rows numbered in file order from 1 and tagged with the file stem."""
    frames = [number_in_file(df.select("*", "_metadata", file_name().alias("filename")), order_col) for df in folder_scans(spark, root, schema)]
    return united(frames).drop("_metadata")


def read_parameters(spark: SparkSession, path: str, key: str, value: str = "value") -> DataFrame:
    """Key-value parameter table."""
    return scan(spark, [path], infer=False).select(F.col(key), F.col(value))


def parameter(table: DataFrame, key: str, name: str, value: str = "value", kind: str = "double"):
    """One parameter as a scalar column, evaluated once."""
    return table.filter(F.col(key) == name).agg(F.max(F.col(value).try_cast(kind))).scalar()


def unique_by_name(spark: SparkSession, root: str) -> dict[str, str]:
    """One table per base name of a tree; the last path wins."""
    return {r["name"]: r["table"] for r in tables_below(spark, root).groupBy("name").agg(F.max("table").alias("table")).collect()}


def promote_header(df: DataFrame, row: int, index: str) -> DataFrame:
    """Use row ``row`` (by the ``index`` column) as column names and drop it and all rows before."""
    first = df.filter(F.col(index) == row).drop(index).first()
    body = df.filter(F.col(index) > row).drop(index)
    return body.toDF(*[str(v) for v in first])
