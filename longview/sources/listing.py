"""Files below a folder as a table, and the first lines of files: work that depends on the number of files only.

Both run in tasks. A folder is listed by the task that holds it, and a header is read by a task that asks the file
system for the first bytes of the file, so neither paths nor contents gather on the driver.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes that tasks open themselves; anything else goes through Spark's readers.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "gcs")
#: Bytes of one ranged read for a header; a longer header takes several.
CHUNK = 16_384
_FILES = "path string, size long, modified timestamp"


def plain_path(path: str) -> str:
    """Path without scheme and host."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without gets that of the session's file system."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path.rstrip("/")
    base = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
    return ("file://" if base in ("file:", "file:/", "file://") else base) + (path.rstrip("/") or "/")


def opened_by_tasks(uri: str) -> bool:
    return uri.split(":", 1)[0] in OPENED


def _store(uri: str):
    """(file system, path in it, what stands before that path)."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    rest = "/" + rest.lstrip("/") if scheme == "file" else rest
    if scheme == "file":
        return fs.LocalFileSystem(), rest, "file://"
    store, path = fs.FileSystem.from_uri({"s3a": "s3"}.get(scheme, scheme) + ":" + rest)
    return store, path, uri[: len(uri) - len(path)]


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def _entries(uri: str, recursive: bool) -> Iterator[tuple[str, bool, int, object]]:
    """(path, is a folder, size, time) below a folder, without what Spark's readers leave out; nothing if there's no such folder."""
    from pyarrow import fs

    store, path, before = _store(uri)
    todo = [path]
    while todo:
        for x in store.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if _hidden(x.base_name):
                continue
            folder = x.type == fs.FileType.Directory
            if folder and recursive:
                todo.append(x.path)
            elif folder or x.type == fs.FileType.File:
                yield before + x.path, folder, x.size or 0, x.mtime


def files_below(spark: SparkSession, root: str, name: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files below ``root`` whose name matches; a table that is never collected here.

    One task lists the root, the folders found there are dealt out and each is listed by one task with all that lies in
    it. Names that begin with an underscore or a dot are left out, as Spark's readers do.
    """
    uri = qualified(spark, root)
    if not opened_by_tasks(uri):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", str(recursive).lower())
        return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def lister(everything: bool):
        def listed(batches):
            for batch in batches:
                for path, folder, size, modified in zip(*[c.to_pylist() for c in batch.columns]):
                    rows = [(path, folder, size, modified)] if not folder else _entries(path, everything)
                    held = []
                    for row in rows:
                        if row[1] or fnmatch.fnmatchcase(row[0].rsplit("/", 1)[1], name):
                            held.append(row)
                        if len(held) == 10_000:
                            yield _batch(held)
                            held = []
                    if held:
                        yield _batch(held)
        return listed

    kinds = "path string, folder boolean, size long, modified timestamp"
    top = spark.createDataFrame([(uri, True, 0, None)], kinds).mapInArrow(lister(False), kinds)
    if recursive:
        top = top.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(lister(True), kinds)
    return top.filter("NOT folder").select("path", "size", "modified")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["path", "folder", "size", "modified"])


def _first_line(uri: str) -> str:
    """The first line of a file, or of the first file of a folder of part files."""
    from pyarrow import fs

    store, path, _ = _store(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        inside = sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and not _hidden(x.base_name))
        if not inside:
            return ""
        path = inside[0]
    got = b""
    with store.open_input_file(path) as f:
        while not re.search(rb"[\r\n]", got) and (more := f.read(CHUNK)):
            got += more
    return re.split(rb"[\r\n]", got, maxsplit=1)[0].decode("utf-8", "replace").removeprefix("﻿")


def with_headers(paths: DataFrame) -> DataFrame:
    """``paths`` (a column path, with scheme) with a column header: the first line, by ranged reads."""
    kind = pa.string()

    def read(batches):
        for batch in batches:
            lines = [_first_line(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, kind)], names=[*batch.schema.names, "header"])

    return paths.mapInArrow(read, f"{', '.join(f'`{n}` {t}' for n, t in paths.dtypes)}, header string")


def headers_of(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Header line of each named file or folder of part files; one job, one ranged read a file."""
    uris = [qualified(spark, f) for f in files]
    if all(map(opened_by_tasks, uris)):
        tasks = min(len(uris), 4 * spark.sparkContext.defaultParallelism)
        rows = spark.createDataFrame(list(enumerate(uris)), "i int, path string").repartition(max(1, tasks), "i")
        found = {r["i"]: r["header"] for r in with_headers(rows).select("i", "header").collect()}
        return {f: found[i] for i, f in enumerate(files)}
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("id"))
    header: dict[str, str] = {}
    for r in lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "id").alias("header")).collect():
        path = plain_path(unquote(r["path"]))
        header[path] = r["header"]
        header.setdefault(path.rsplit("/", 1)[0], r["header"])
    return {f: header.get(plain_path(f), "") for f in files}


def states_of(spark: SparkSession, tables: list[str]) -> dict[str, str]:
    """A text per named file or folder of part files that changes when a name, size or time of its files does.

    One job over the names; contents are not read.  A table that isn't there has the empty text.
    """
    uris = [qualified(spark, t) for t in tables]

    def look(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch.column(1).to_pylist():
                store, path, _ = _store(uri)
                info = store.get_file_info(path)
                inside = [info] if info.type == fs.FileType.File else [] if info.type == fs.FileType.NotFound else store.get_file_info(fs.FileSelector(path))
                seen = sorted(f"{x.base_name} {x.size} {x.mtime_ns}" for x in inside if not _hidden(x.base_name) and x.type == fs.FileType.File)
                out.append(hashlib.sha256("\n".join(seen).encode()).hexdigest() if seen else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["i", "state"])

    if all(map(opened_by_tasks, uris)):
        tasks = max(1, min(len(uris), 4 * spark.sparkContext.defaultParallelism))
        rows = spark.createDataFrame(list(enumerate(uris)), "i int, path string").repartition(tasks, "i").mapInArrow(look, "i int, state string")
        found = {r["i"]: r["state"] for r in rows.collect()}
        return {t: found[i] for i, t in enumerate(tables)}
    out = {}
    for t, uri in zip(tables, uris):
        files = spark.read.format("binaryFile").load(uri).select(F.concat_ws(" ", "path", "length", F.unix_micros("modificationTime")).alias("s"))
        out[t] = hashlib.sha256("\n".join(sorted(r[0] for r in files.collect())).encode()).hexdigest()
    return out
