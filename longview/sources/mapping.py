"""Column mapper: any table to the canonical long form."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.sources import csvfiles, sinks
from longview.sources.scenarios import MARKER, OUTPUT_DIR

# Time parts and what stands in for a missing one.
TIME_DEFAULTS = {"year": None, "month": 12, "day": 31, "hour": 23}


def detect_time_columns(columns: list[str]) -> dict:
    """For each time part the first column with that whole word in its name, else the default."""
    found = dict(TIME_DEFAULTS)
    for part in found:
        for c in columns:
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", c).lower())
            if part in words:
                found[part] = c
                break
    return found


def ordered_mapping(dims: dict) -> dict:
    """Mapping entries in canonical order: Dim1, time parts, value, other dimensions."""
    keys = ["Dim1", *TIME_DEFAULTS, "val"]
    first = {k: dims[k] for k in keys if k in dims}
    return first | {k: v for k, v in dims.items() if k.startswith("Dim") and k != "Dim1"}


def apply_mapping(df: DataFrame, dims: dict) -> DataFrame:
    """Select the mapped columns; a name the table lacks is taken as a constant.

    The value column keeps its source name and comes last.
    """
    def pick(v):
        return F.col(v) if isinstance(v, str) and v in df.columns else F.lit(v)

    out = [pick(v).alias(k) for k, v in ordered_mapping(dims).items() if k.startswith("Dim") or k in TIME_DEFAULTS]
    if "val" in dims:
        out.append(pick(dims["val"]).alias(str(dims["val"])))
    return df.select(*out)


class MappingStore:
    """Named mappings as JSON: ``{name: {original_file, dimensions}}``.

    With a session the text lives wherever Spark can write (shared storage of a
    cluster); without one it is a plain file.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def load(self) -> dict:
        try:
            if self.spark is not None:
                return json.loads(self.spark.read.text(self.path, wholetext=True).first()[0])
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except (FileNotFoundError, AnalysisException):
            return {}

    def _write(self, items: dict) -> None:
        text = json.dumps(items, indent=4)
        if self.spark is not None:
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
            return
        with open(self.path, "w", encoding="utf-8") as f:
            f.write(text)

    def save(self, name: str, original_file: str, dims: dict) -> None:
        items = self.load()
        items[name] = {"original_file": original_file, "dimensions": ordered_mapping(dims)}
        self._write(items)

    def delete(self, name: str) -> None:
        items = self.load()
        del items[name]
        self._write(items)

    def names(self) -> list[str]:
        return list(self.load())


def mapped_runs(spark: SparkSession, root: str, file: str, dims: dict) -> DataFrame:
    """All tables of one name below ``root`` in canonical form, tagged with their folder."""
    files = csvfiles.tables_of(spark, root, file)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.element_at(F.split(path, f"\\Q{root.rstrip('/')}\\E/", 2), -1)
    folder = F.regexp_extract(below, rf"^(.*?)/?\Q{file}\E(/[^/]*)?$", 1)
    raw = csvfiles.scan(spark, files, extra={"__run": F.when(folder == "", F.lit(".")).otherwise(folder)})
    mapped = apply_mapping(raw, {**dims, "Dim__run": "__run"})
    return mapped.withColumnRenamed("Dim__run", "scenario")


def apply_all(spark: SparkSession, store: MappingStore, root: str, out: str, partitioned: bool = False) -> list[str]:
    """Write the canonical form of every mapped file.

    Default layout: ``<out>/<folder>/outputs/<name>.csv`` with the run marker: one job a mapping writes the tables of
    all runs, which are then moved to their folders.  ``partitioned`` leaves them as ``<out>/<name>/scenario=<folder>``.
    """
    written, staged = [], {}
    for name, item in store.load().items():
        df = mapped_runs(spark, root, item["original_file"], item["dimensions"])
        target = f"{out}/{name}" if partitioned else f"{out}/_{uuid.uuid4().hex}"
        df.write.mode("errorifexists").partitionBy("scenario").option("header", True).csv(target)
        if partitioned:
            written.append(target)
        else:
            staged[target] = f"{OUTPUT_DIR}/{name}.csv"
    return written + sinks.publish_runs(spark, staged, out, "scenario", f"{OUTPUT_DIR}/{MARKER}")
