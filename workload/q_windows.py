"""Window operators (W), ordering, top-N and binning (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate as agg
from longview.operators import joins, ordered, prep, project, ranking, windows
from longview.plans.demand import hourly
from workload.facts import events, events_sql, facts, facts_sql, table
from workload.q_aggregate import BALANCES, _balances
from workload.registry import query, r, rounded

YB = f"(SELECT brand, year, sum(b) AS y FROM {facts_sql('brand', 'year', 'b')} GROUP BY 1, 2)"
# Yearly sums with some years removed, on a complete axis.
GAPS = f"""(SELECT a.brand, a.year, g.y FROM (SELECT DISTINCT brand, CAST(unnest(range(1994, 2004)) AS INTEGER) AS year FROM {YB}) a
LEFT JOIN (SELECT * FROM {YB} WHERE (year * 7 + CAST(substring(brand, 7) AS INTEGER)) % 3 <> 0) g ON g.brand = a.brand AND g.year = a.year)"""


def _yearly(spark, sf):
    return agg.aggregate(facts(spark, sf, "brand", "year", "b"), ["brand", "year"], "sum(a)", "b").withColumnRenamed("b", "y")


def _gaps(spark, sf):
    d = _yearly(spark, sf)
    kept = d.filter((F.col("year") * 7 + F.substring("brand", 7, 9).cast("int")) % 3 != 0)
    axis = joins.expand_years(d.select("brand").distinct(), 1994, 2003)
    return axis.join(kept, ["brand", "year"], "left")


@query("w1_lag", f"SELECT brand, year, y, lag(y) OVER (PARTITION BY brand ORDER BY year) AS prev FROM {YB}")
def _(spark, sf):
    return windows.lag_by(_yearly(spark, sf), "y", ["brand"], ["year"], "prev")


@query("w1_lag_any_size", "SELECT event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return windows.lag_by(d, "value", ["event_type"], ["ts", "event_id"], "prev", ordered.plan_slices(d, "ts", ["event_type"])).select("event_id", "value", "prev")


@query("w2_partition_total", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return windows.group_total(d, "l_quantity", ["l_returnflag"], "total", raw=True).select("l_orderkey", "l_linenumber", "total")


@query("w3_running_sum", f"SELECT brand, year, y, sum(y) OVER (PARTITION BY brand ORDER BY year) AS cum FROM {YB}")
def _(spark, sf):
    return windows.running_sum(_yearly(spark, sf), "y", ["brand"], ["year"], "cum")


@query("w3_running_sum_any_size", f"SELECT event_id, {r('sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 2)} AS cum FROM events")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    d = windows.running_sum(d, "value", ["event_type"], ["ts", "event_id"], "cum", ordered.plan_slices(d, "ts", ["event_type"]))
    return rounded(d.select("event_id", "cum"), 2, "cum")


@query("w4_rolling_sum", f"""
SELECT brand, year, CASE WHEN count(y) OVER w = 3 THEN sum(y) OVER w END AS y FROM {GAPS}
WINDOW w AS (PARTITION BY brand ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return windows.rolling_sum(_gaps(spark, sf), "y", ["brand"], ["year"], 3)


@query("w5_forward_fill", f"SELECT brand, year, last_value(y IGNORE NULLS) OVER (PARTITION BY brand ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM {GAPS}")
def _(spark, sf):
    return windows.ffill(_gaps(spark, sf), "y", ["brand"], ["year"])


@query("w5_forward_fill_limited", f"SELECT brand, year, last_value(y IGNORE NULLS) OVER (PARTITION BY brand ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS y FROM {GAPS}")
def _(spark, sf):
    return windows.ffill(_gaps(spark, sf), "y", ["brand"], ["year"], limit=1)


@query("w5_forward_fill_any_size", """
SELECT event_id, last_value(CASE WHEN value > 200 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM events""")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", "ts", F.when(F.col("value") > 200, F.col("value")).alias("high"))
    return windows.ffill(d, "high", ["event_type"], ["ts", "event_id"], slices=ordered.plan_slices(d, "ts", ["event_type"])).select("event_id", "high")


@query("w6_backward_fill", f"SELECT brand, year, first_value(y IGNORE NULLS) OVER (PARTITION BY brand ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM {GAPS}")
def _(spark, sf):
    return windows.bfill(_gaps(spark, sf), "y", ["brand"], ["year"])


@query("w7_interpolation", f"""
WITH k AS (SELECT brand, year, y,
 last_value(CASE WHEN y IS NOT NULL THEN year END IGNORE NULLS) OVER a AS y0, last_value(y IGNORE NULLS) OVER a AS v0,
 first_value(CASE WHEN y IS NOT NULL THEN year END IGNORE NULLS) OVER b AS y1, first_value(y IGNORE NULLS) OVER b AS v1 FROM {GAPS}
 WINDOW a AS (PARTITION BY brand ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY brand ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT brand, year, {r('CASE WHEN y IS NOT NULL THEN y WHEN y1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (CAST(year - y0 AS DOUBLE) / nullif(y1 - y0, 0)) END')} AS y FROM k""")
def _(spark, sf):
    return rounded(windows.interpolate(_gaps(spark, sf), "y", ["brand"], "year"), 4, "y")


# Event rows by type: five groups that grow with the table, always cut into slices.
EVENT_ORDER = "(PARTITION BY event_type ORDER BY ts, event_id"
SOME = "CASE WHEN event_id % 5 <> 0 THEN value END"
HIGH = "CASE WHEN value > 400 THEN value END"


def _sliced(spark, sf, value):
    d = table(spark, sf, "events").select("event_id", "event_type", "ts", F.expr(value).alias("y"))
    return d, ordered.plan_slices(d, "ts", ["event_type"], least=12)


@query("w4_rolling_sum_any_size", f"""
SELECT event_id, CASE WHEN count(y) OVER w = 4 THEN {r('sum(y) OVER w', 2)} END AS y FROM (SELECT *, {SOME} AS y FROM events)
WINDOW w AS {EVENT_ORDER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    d, slices = _sliced(spark, sf, SOME)
    return rounded(windows.rolling_sum(d, "y", ["event_type"], ["ts", "event_id"], 4, slices=slices).select("event_id", "y"), 2, "y")


@query("w5_forward_fill_limited_any_size", f"SELECT event_id, last_value({HIGH} IGNORE NULLS) OVER {EVENT_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y FROM events")
def _(spark, sf):
    d, slices = _sliced(spark, sf, HIGH)
    return windows.ffill(d, "y", ["event_type"], ["ts", "event_id"], 2, slices=slices).select("event_id", "y")


@query("w6_backward_fill_any_size", f"SELECT event_id, first_value({HIGH} IGNORE NULLS) OVER {EVENT_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM events")
def _(spark, sf):
    d, slices = _sliced(spark, sf, HIGH)
    return windows.bfill(d, "y", ["event_type"], ["ts", "event_id"], slices=slices).select("event_id", "y")


@query("w7_interpolation_any_size", f"""
WITH n AS (SELECT event_id, event_type, ts, {HIGH} AS y, row_number() OVER {EVENT_ORDER}) AS i FROM events),
k AS (SELECT event_id, y, i, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(y IGNORE NULLS) OVER a AS v0,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(y IGNORE NULLS) OVER b AS v1 FROM n
 WINDOW a AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, {r('CASE WHEN y IS NOT NULL THEN y WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (CAST(i - i0 AS DOUBLE) / nullif(i1 - i0, 0)) END')} AS y FROM k""")
def _(spark, sf):
    d, slices = _sliced(spark, sf, HIGH)
    return rounded(windows.interpolate(d, "y", ["event_type"], ["ts", "event_id"], slices=slices).select("event_id", "y"), 4, "y")


@query("w8_stack_levels", f"""
WITH g AS (SELECT * FROM {BALANCES} WHERE length(rb) % 2 = 0 OR segment <> 'BUILDING'), f AS (SELECT rb, segment, coalesce(g.y, 0) AS y FROM (SELECT DISTINCT rb FROM g) CROSS JOIN (SELECT DISTINCT segment FROM g) LEFT JOIN g USING (rb, segment))
SELECT rb, segment, {r('y', 2)} AS y, {r('pos - CASE WHEN y > 0 THEN y ELSE 0 END', 2)} AS base_pos, {r('pos', 2)} AS top_pos, {r('neg - CASE WHEN y < 0 THEN y ELSE 0 END', 2)} AS base_neg, {r('neg', 2)} AS top_neg FROM
(SELECT *, sum(CASE WHEN y > 0 THEN y ELSE 0 END) OVER w AS pos, sum(CASE WHEN y < 0 THEN y ELSE 0 END) OVER w AS neg FROM f
 WINDOW w AS (PARTITION BY rb ORDER BY segment))""")
def _(spark, sf):
    d = _balances(spark, sf).filter("length(rb) % 2 = 0 OR segment <> 'BUILDING'")  # leaves missing pairs
    return rounded(prep.stack_levels(d, "rb", "y", "segment"), 2, "y", "base_pos", "top_pos", "base_neg", "top_neg")


@query("w9_net_line", f"SELECT rb, {r('sum(y)', 2)} AS net FROM {BALANCES} GROUP BY 1")
def _(spark, sf):
    return rounded(prep.net_line(_balances(spark, sf), "rb", "y"), 2, "net")


@query("w10_bar_positions", f"""
WITH w AS (SELECT p_type AS display, CAST(count(*) AS DOUBLE) AS width FROM part GROUP BY 1), d AS (SELECT flag, tech, sum(b) AS y FROM {facts_sql('flag', 'tech', 'b')} GROUP BY 1, 2)
SELECT flag, tech, y, width, sum(width) OVER (PARTITION BY flag ORDER BY tech) AS cumulative, sum(width) OVER (PARTITION BY flag ORDER BY tech) - width / 2 AS position,
{r('width / (SELECT max(width) FROM w)', 6)} AS relative_width FROM d JOIN w ON tech = display""")
def _(spark, sf):
    widths = table(spark, sf, "part").groupBy(F.col("p_type").alias("display")).agg(F.count(F.lit(1)).cast("double").alias("width"))
    d = agg.aggregate(facts(spark, sf, "flag", "tech", "b"), ["flag", "tech"], "sum(a)", "b").withColumnRenamed("b", "y")
    return rounded(prep.bar_positions(d, "tech", widths, ["flag"]), 6, "relative_width")


@query("w11_top_rows_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 40""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top_rows(d, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 40)


@query("w12_series_rank", "SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand <> 'Brand#3', p_brand) - 1 AS INTEGER) AS color_index FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, sf):
    return prep.series_colors(table(spark, sf, "part"), "p_brand", ["Brand#3"]).select("p_brand", "color_index")


@query("w13_share_of_partition", f"SELECT l_orderkey, l_linenumber, {r('l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey)', 8)} AS share FROM lineitem")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return rounded(windows.share(d, "l_quantity", ["l_suppkey"], raw=True).select("l_orderkey", "l_linenumber", "share"), 8, "share")


# ---- ordering and binning ------------------------------------------------------------

@query("t1_multi_key_sort", f"SELECT flag, tech, year, {r('sum(b)', 2)} AS b FROM {facts_sql('flag', 'tech', 'year', 'b')} GROUP BY 1, 2, 3 ORDER BY 1, 2, 3")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "flag", "tech", "year", "b"), ["flag", "tech", "year"], "sum(a)", "b")
    return rounded(ranking.sort_rows(d, ["flag", "tech", "year"]), 2, "b")


@query("t2_custom_order", f"""
SELECT scenario, CAST(CASE scenario WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS INTEGER) AS position, {r('sum(b)', 2)} AS b FROM {facts_sql('scenario', 'b')} GROUP BY 1, 2""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "scenario", "b"), ["scenario"], "sum(a)", "b")
    order = ["5-LOW", "2-HIGH"]
    d = ranking.sort_rows(d.withColumn("position", ranking.order_rank("scenario", order)), ["scenario"], {"scenario": order})
    return rounded(d, 2, "b")


STYLE = "(SELECT p_brand AS \"order\", row_number() OVER (ORDER BY p_brand) AS seq, concat('#', p_brand) AS color FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 48))"


@query("t3_styled_values", f"""
SELECT p_brand, CAST(seq IS NULL AS INTEGER) AS unlisted, CAST(coalesce(seq, 0) AS BIGINT) AS position, coalesce(color, '#ff69b4') AS color FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN {STYLE} s ON s."order" = p_brand""")
def _(spark, sf):
    names = table(spark, sf, "part").filter("p_size > 48").select("p_brand").distinct()
    style = ordered.number_rows(names, [], ["p_brand"], "seq")
    style = style.select(F.col("p_brand").alias("order"), "seq", F.concat(F.lit("#"), "p_brand").alias("color"))
    return ranking.styled_values(table(spark, sf, "part"), "p_brand", style, "seq")


@query("t4_custom_style_sheet", f"""
SELECT tech, {r('sum(b)', 2)} AS b, CAST(CASE WHEN tech = 'ECONOMY' THEN 2 WHEN tech = 'LARGE' THEN 1 ELSE 3 END AS INTEGER) AS position, CASE tech WHEN 'LARGE' THEN '#222222' WHEN 'ECONOMY' THEN '#820000' END AS color FROM {facts_sql('tech', 'b')} x GROUP BY tech""")
def _(spark, sf):
    sheet = spark.createDataFrame([("LARGE", "#222222", "a"), ("ECONOMY", "#820000", None), (None, None, None)], "tech string, tech_custom_colors string, other string")
    orders, colors = ranking.custom_styles(sheet)
    d = agg.aggregate(facts(spark, sf, "tech", "b"), ["tech"], "sum(a)", "b")
    tint = F.try_element_at(F.create_map(*[F.lit(v) for p in colors["tech"].items() for v in p]), F.col("tech"))
    d = d.withColumn("position", ranking.order_rank("tech", orders["tech"])).withColumn("color", tint)
    return rounded(d, 2, "b")


@query("t5_sort_by_cumulative", f"SELECT rb, segment, y FROM {BALANCES} ORDER BY sum(y) OVER (PARTITION BY rb) DESC, segment")
def _(spark, sf):
    d = prep.cumulative_key(_balances(spark, sf), "y", ["rb"], descending=True)
    return ranking.sort_rows(d, ["y_cumulative", "segment"]).drop("y_cumulative")


@query("t6_top_n_series", f"""
WITH f AS {facts_sql('brand', 'year', 'a')}, t AS (SELECT brand FROM f GROUP BY 1 ORDER BY sum(abs(a)) DESC, brand LIMIT 5)
SELECT CASE WHEN brand IN (SELECT brand FROM t) THEN brand ELSE 'Other' END AS brand, year, {r('sum(a)', 2)} AS a FROM f GROUP BY 1, 2""")
def _(spark, sf):
    d = facts(spark, sf, "brand", "year", "a")
    return rounded(agg.aggregate_top(d, ["brand", "year"], "sum(a)", "a", series="brand", n=5), 2, "a")


@query("t6_top_n_weighted", f"""
WITH f AS {facts_sql('brand', 'year', 'a', 'b', 'c')}, t AS (SELECT brand FROM f GROUP BY 1 ORDER BY sum(abs(a)) DESC, brand LIMIT 3)
SELECT CASE WHEN brand IN (SELECT brand FROM t) THEN brand ELSE 'Other' END AS brand, year, {r('sum(a * b) / sum(c)')} AS a, {r('min(a)', 2)} AS range_min, {r('max(a)', 2)} AS range_max FROM f GROUP BY 1, 2""")
def _(spark, sf):
    d = facts(spark, sf, "brand", "year", "a", "b", "c")
    d = agg.aggregate_top(d, ["brand", "year"], "sum(a*b)/sum(c)", "a", "b", "c", True, "brand", 3)
    return rounded(rounded(d, 4, "a"), 2, "range_min", "range_max")


@query("t6_top_n_rows", f"""
WITH t AS (SELECT event_type FROM events GROUP BY 1 ORDER BY sum(abs(value)) DESC, event_type LIMIT 2)
SELECT event_id, CASE WHEN event_type IN (SELECT event_type FROM t) THEN event_type ELSE 'Other' END AS event_type, value FROM events""")
def _(spark, sf):
    return ranking.top_n_series(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value", 2)


@query("t7_timeslice_labels", f"""
SELECT h, {r('sum(value)', 2)} AS value FROM (SELECT CASE hour % 3 WHEN 0 THEN 'h01 (Summer 10pm-6am)' WHEN 1 THEN 'h02 (Summer 6am-1pm)' ELSE 'h03 (Summer 1pm-5pm)' END AS h, value FROM {events_sql('hour', 'value')}) GROUP BY 1""")
def _(spark, sf):
    d = events(spark, sf, "hour", "value").select(F.concat(F.lit("h"), (F.col("hour") % 3 + 1).cast("string")).alias("h"), "value")
    return rounded(ranking.sort_timeslices(agg.aggregate(d, ["h"], "sum(a)", "value")), 2, "value")


@query("t7_timeslice_padding", f"SELECT lpad(CAST(hoy AS VARCHAR), 6, '0') AS h, {r('sum(value)', 2)} AS value FROM {events_sql('hoy', 'value')} GROUP BY 1")
def _(spark, sf):
    d = events(spark, sf, "hoy", "value").select(F.concat(F.lit("h"), F.col("hoy").cast("string")).alias("h"), "value")
    return rounded(ranking.sort_timeslices(agg.aggregate(d, ["h"], "sum(a)", "value")), 2, "value")


@query("t8_strip_sorted_zeros", f"SELECT ltrim(h, '0') AS h, {r('sum(value)', 2)} AS value FROM (SELECT lpad(CAST(hoy AS VARCHAR), 6, '0') AS h, value FROM {events_sql('hoy', 'value')}) GROUP BY 1")
def _(spark, sf):
    d = events(spark, sf, "hoy", "value").select(S.zero_pad("hoy", 6).alias("h"), "value")
    return rounded(ranking.sort_rows(agg.aggregate(d, ["h"], "sum(a)", "value"), ["h"]), 2, "value")


SPEND = f"(SELECT user_id, {r('sum(value)', 2)} AS y FROM events GROUP BY 1)"


def _spend(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("y"))
    return rounded(d, 2, "y")


_RANKED = f"(SELECT y, row_number() OVER (ORDER BY y) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT y FROM {SPEND}))"


@query("t9_equal_number_breakpoints", "SELECT " + ", ".join(f"max(CASE WHEN k = CAST(floor({i + 1} * ((n - 1) / 9.0::DOUBLE)) AS BIGINT) THEN y END) AS bp_{i}" for i in range(8)) + f" FROM {_RANKED}")
def _(spark, sf):
    return ranking.breakpoint_table(_spend(spark, sf), "y", 9)


@query("t10_equal_width_bins", f"""
WITH d AS {SPEND}, w AS (SELECT min(y) AS lo, (max(y) - min(y)) / 7 AS w FROM d)
SELECT user_id, y, CAST({' + '.join(f'CAST(y > lo + w + w * {i} AS INTEGER)' for i in range(6))} AS INTEGER) AS bin_index FROM d CROSS JOIN w""")
def _(spark, sf):
    d = _spend(spark, sf)
    return ranking.assign_bins(d, "y", ranking.breakpoints(d, "y", "equal width", 7))


@query("t10_equal_width_bins_limits", f"SELECT user_id, y, CAST({' + '.join(f'CAST(y > 1000 + 250 * {i} AS INTEGER)' for i in range(5))} AS INTEGER) AS bin_index FROM {SPEND}")
def _(spark, sf):
    d = _spend(spark, sf)
    return ranking.assign_bins(d, "y", ranking.breakpoints(d, "y", "equal width", 6, lo=1000, hi=2000))


@query("t11_manual_bins", f"SELECT user_id, y, CAST(CAST(y > -10 AS INTEGER) + CAST(y > 500.5 AS INTEGER) + CAST(y > 2000 AS INTEGER) AS INTEGER) AS bin_index FROM {SPEND}")
def _(spark, sf):
    d = _spend(spark, sf)
    return ranking.assign_bins(d, "y", ranking.breakpoints(d, "y", "manual", manual="-10,500.5,2000"))


@query("t12_bin_index", f"""
WITH r AS {_RANKED}, b AS (SELECT y FROM r WHERE k IN ({', '.join(f'CAST(floor({i + 1} * ((n - 1) / 9.0::DOUBLE)) AS BIGINT)' for i in range(8))}))
SELECT user_id, d.y, CAST((SELECT count(*) FROM b WHERE d.y > b.y) AS INTEGER) AS bin_index FROM {SPEND} d""")
def _(spark, sf):
    d = _spend(spark, sf)
    return ranking.assign_bins(d, "y", ranking.breakpoints(d, "y", "equal number", 9))


@query("t13_bin_labels", f"SELECT user_id, CASE WHEN y <= 100 THEN '<= 100' WHEN y <= 1500 THEN '100 - 1500' WHEN y <= 250000 THEN '1500 - 2.50E+05' ELSE '> 2.50E+05' END AS bin_label FROM {SPEND}")
def _(spark, sf):
    breaks = [100.0, 1500.0, 250000.0]
    d = ranking.assign_bins(_spend(spark, sf), "y", breaks)
    return ranking.label_bins(d, "bin_index", breaks).select("user_id", "bin_label")


@query("t14_panels", f"SELECT flag, tech, count(*) AS rows FROM {facts_sql('flag', 'tech')} GROUP BY 1, 2")
def _(spark, sf):
    return prep.panels(facts(spark, sf, "flag", "tech"), "tech", "flag")


@query("t15_legend", """
SELECT p_type, CAST(n - 1 AS INTEGER) AS color_index, list_extract(['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd', '#8c564b'], n) AS color FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) AS n FROM (SELECT DISTINCT p_type FROM part))""")
def _(spark, sf):
    return prep.legend(table(spark, sf, "part"), "p_type")


@query("t16_x_domain", f"""
WITH f AS {facts_sql('brand', 'flag')} SELECT b.flag, a.brand, b.flag || ' ' || a.brand AS label FROM (SELECT DISTINCT brand FROM f) a CROSS JOIN (SELECT DISTINCT flag FROM f) b""")
def _(spark, sf):
    return prep.x_domain(facts(spark, sf, "brand", "flag"), "brand", "flag")
