"""Canonical long facts over the test tables, in Spark and in SQL.

Only the joins behind the wanted columns are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.shared import materialise, new_folder

__all__ = ["events", "events_sql", "facts", "facts_sql", "materialise", "scratch", "table"]

_BASE = {
    "flag": ("l_returnflag", "l_returnflag"), "status": ("l_linestatus", "l_linestatus"),
    "year": ("year(l_shipdate)", "CAST(year(l_shipdate) AS INTEGER)"),
    "month": ("month(l_shipdate)", "CAST(month(l_shipdate) AS INTEGER)"),
    "day": ("day(l_shipdate)", "CAST(day(l_shipdate) AS INTEGER)"),
    "a": ("l_extendedprice", "l_extendedprice"), "b": ("l_quantity", "l_quantity"),
    "c": ("1 + l_tax", "1 + l_tax"), "disc": ("l_discount", "l_discount"),
    "line": ("l_linenumber", "l_linenumber"), "partkey": ("l_partkey", "l_partkey"),
    "suppkey": ("l_suppkey", "l_suppkey"), "orderkey": ("l_orderkey", "l_orderkey"),
}
_ORDER = {"scenario": "o_orderpriority", "orderstatus": "o_orderstatus", "custkey": "o_custkey"}
_PART = {"tech": "p_type", "brand": "p_brand", "size": "p_size"}
_CUST = {"segment": "c_mktsegment", "rb": "n_name"}
_SUPP = {"from_nation": "s_nationkey"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _needs(cols):
    cust = any(c in _CUST for c in cols)
    return (cust or any(c in _ORDER for c in cols), any(c in _PART for c in cols), cust, "rb" in cols,
            any(c in _SUPP for c in cols))


def facts(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Line facts with the named columns."""
    order, part, cust, nation, supp = _needs(cols)
    d = table(spark, sf, "lineitem")
    if order:
        d = d.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if part:
        d = d.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if cust:
        d = d.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if nation:
        d = d.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if supp:
        d = d.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    exprs = []
    for c in cols:
        src = _BASE[c][0] if c in _BASE else {**_ORDER, **_PART, **_CUST, **_SUPP}[c]
        exprs.append(F.expr(src).alias(c))
    return d.select(*exprs)


def facts_sql(*cols: str) -> str:
    order, part, cust, nation, supp = _needs(cols)
    d = "lineitem"
    if order:
        d += " JOIN orders ON l_orderkey = o_orderkey"
    if part:
        d += " JOIN part ON l_partkey = p_partkey"
    if cust:
        d += " JOIN customer ON o_custkey = c_custkey"
    if nation:
        d += " JOIN nation ON c_nationkey = n_nationkey"
    if supp:
        d += " JOIN supplier ON l_suppkey = s_suppkey"
    names = {**_ORDER, **_PART, **_CUST, **_SUPP}
    exprs = ", ".join(f"{_BASE[c][1] if c in _BASE else names[c]} AS {c}" for c in cols)
    return f"(SELECT {exprs} FROM {d})"


_EVENT = {
    "scenario": ("concat('w', cast(floor((day(ts) - 1) / 7) as int) + 1)",
                 "concat('w', CAST(floor((day(ts) - 1) / 7) AS INTEGER) + 1)"),
    "tech": ("event_type", "event_type"),
    "rb": ("cast(user_id % 10 as string)", "CAST(user_id % 10 AS VARCHAR)"),
    "user": ("user_id", "user_id"), "id": ("event_id", "event_id"), "ts": ("ts", "ts"),
    "year": ("year(ts)", "CAST(year(ts) AS INTEGER)"), "month": ("month(ts)", "CAST(month(ts) AS INTEGER)"),
    "day": ("day(ts)", "CAST(day(ts) AS INTEGER)"), "hour": ("hour(ts)", "CAST(hour(ts) AS INTEGER)"),
    "value": ("value", "value"),
    "hoy": ("(dayofyear(ts) - 1) * 24 + hour(ts) + 1", "CAST((dayofyear(ts) - 1) * 24 + hour(ts) + 1 AS INTEGER)"),
}


def events(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    d = table(spark, sf, "events")
    return d.select(*[F.expr(_EVENT[c][0]).alias(c) for c in cols])


def events_sql(*cols: str) -> str:
    return f"(SELECT {', '.join(f'{_EVENT[c][1]} AS {c}' for c in cols)} FROM events)"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared directory of the cluster."""
    return new_folder(spark)
