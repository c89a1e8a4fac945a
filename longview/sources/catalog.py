"""Automatic catalogue of roll-ups over a tree of result files (schemas only)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from longview.operators import aggregate, project
from longview.sources import csvfiles
from longview.sources.scenarios import MARKER

# Roll-up names and the filters of their default view.
GRAIN_NAMES = {"year": "Yearly", "month": "Monthly", "day": "Daily", "hour": "Hourly"}
NOT_VALUES = ("tech", "Dim1", "year", "month", "day", "hour")


def value_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in NOT_VALUES]


def default_view(value: str, grain: str) -> dict:
    """Stacked bars per scenario; coarser time parts are fixed to their last value."""
    grains = aggregate.GRAINS
    return {"x": grain, "y": value, "series": "tech", "explode": "scenario", "chart_type": "Bar",
            "bar_width": "1", "filter": {g: "last" for g in grains[:grains.index(grain)]}}


def describe_file(file: str, columns: list[str], grains=aggregate.GRAINS, scale: float = 1.0) -> dict[str, dict]:
    """Catalogue entries of one table, one per value column and grain."""
    entries = {}
    for value in value_columns(columns):
        for grain in grains:
            keys = ["tech", *aggregate.GRAINS[:aggregate.GRAINS.index(grain) + 1]]
            entries[f"{value} ({GRAIN_NAMES[grain]})"] = {
                "file": file, "value": value,
                "columns": ["tech", *columns[1:]],
                "preprocess": [
                    {"func": aggregate.sum_over, "args": {"group_cols": keys, "val_cols": [value]}},
                    {"func": project.scale, "args": {"column": value, "factor": scale}}],
                "index": keys,
                "presets": {"Stacked Bars": default_view(value, grain)}}
    return entries


def build_catalog(spark: SparkSession, root: str, grains=aggregate.GRAINS, scale: float = 1.0,
                  marker: str = MARKER) -> dict[str, dict]:
    """Catalogue of every result file below ``root``, sorted by name.

    Only headers are read.  Equal value names of different files get the file name
    as a prefix instead of overwriting each other.
    """
    first = csvfiles.tables_below(spark, root).filter(F.col("name") != marker).groupBy("name").agg(F.min("table").alias("path"))
    found = {r["path"]: r["name"] for r in first.collect()}  # one row per table name
    tables: dict[str, list[str]] = {}
    for same in csvfiles.by_header(spark, list(found)).values() if found else []:
        columns = spark.read.option("header", True).csv(same[0]).columns
        tables.update((found[path], columns) for path in same)
    entries: dict[str, dict] = {}
    for table, columns in sorted(tables.items()):
        for key, meta in describe_file(table, columns, grains, scale).items():
            entries[key if key not in entries else f"{table}: {key}"] = meta
    return dict(sorted(entries.items()))
