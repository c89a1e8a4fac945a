"""Registration of queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return wrap


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def r(expr: str, digits: int = 4) -> str:
    """SQL rounding without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"
