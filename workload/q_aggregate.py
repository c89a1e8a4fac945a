"""Aggregations (A), comparisons (C), set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate as agg
from longview.operators import joins, ordered, prep, project, reshape
from longview.operators.compare import compare, compare_chain
from workload.facts import events, events_sql, facts, facts_sql, table
from workload.registry import query, r, rounded

KEYS = ["scenario", "tech", "year"]
FA = facts_sql("scenario", "tech", "year", "a", "b", "c")


def _view_agg(name, how, sql, digits):
    @query(name, f"SELECT scenario, tech, year, {r(sql, digits)} AS a FROM {FA} GROUP BY 1, 2, 3")
    def run(spark, sf):
        d = facts(spark, sf, "scenario", "tech", "year", "a", "b", "c")
        return rounded(agg.aggregate(d, KEYS, how, "a", "b", "c"), digits, "a")
    return run


_view_agg("a1_sum", "sum(a)", "sum(a)", 2)
_view_agg("a2_average", "ave(a)", "avg(a)", 4)
_view_agg("a3_ratio_of_sums", "sum(a)/sum(b)", "sum(a) / nullif(sum(b), 0)", 4)
_view_agg("a4_weighted_mean", "sum(a*b)/sum(b)", "sum(a * b) / nullif(sum(b), 0)", 4)
_view_agg("a5_weighted_ratio", "sum(a*b)/sum(c)", "sum(a * b) / nullif(sum(c), 0) / 1.0", 3)
_view_agg("a6_ratio_of_weighted_means", "[sum(a*b)/sum(b)]/[sum(a*c)/sum(c)]",
          "(sum(a * b) / nullif(sum(b), 0)) / nullif(sum(a * c) / nullif(sum(c), 0), 0)", 6)


@query("a7_within_series_range",
       f"SELECT scenario, tech, year, {r('avg(a)')} AS a, min(a) AS range_min, max(a) AS range_max FROM {FA} GROUP BY 1, 2, 3")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, *KEYS, "a"), KEYS, "ave(a)", "a", within_range=True)
    return rounded(d, 4, "a")


@query("a8_yearly_rollup", f"SELECT tech, year, {r('sum(a)', 2)} AS a, {r('sum(b)', 2)} AS b FROM {facts_sql('tech', 'year', 'a', 'b')} GROUP BY 1, 2")
def _(spark, sf):
    return rounded(agg.rollup_time(facts(spark, sf, "tech", "year", "month", "day", "a", "b"), ["tech"], "year", ["a", "b"]), 2, "a", "b")


@query("a9_monthly_rollup", f"SELECT tech, year, month, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'year', 'month', 'a')} GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(agg.rollup_time(facts(spark, sf, "tech", "year", "month", "day", "a"), ["tech"], "month", ["a"]), 2, "a")


@query("a10_daily_rollup", f"SELECT tech, year, month, day, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'year', 'month', 'day', 'a')} GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return rounded(agg.rollup_time(facts(spark, sf, "tech", "year", "month", "day", "a"), ["tech"], "day", ["a"]), 2, "a")


@query("a11_hourly_rollup", f"SELECT tech, year, month, day, hour, {r('sum(value)', 2)} AS value FROM {events_sql('tech', 'year', 'month', 'day', 'hour', 'value')} GROUP BY 1, 2, 3, 4, 5")
def _(spark, sf):
    return rounded(agg.rollup_time(events(spark, sf, "tech", "year", "month", "day", "hour", "value"), ["tech"], "hour", ["value"]), 2, "value")


@query("a12_densify", f"""
WITH e AS {events_sql('scenario', 'tech', 'rb', 'day', 'value')},
g AS (SELECT scenario, tech, rb, day, sum(value) AS value FROM e GROUP BY 1, 2, 3, 4)
SELECT s.scenario, t.tech, b.rb, d.day, {r('coalesce(g.value, 0)', 2)} AS value
FROM (SELECT DISTINCT scenario FROM e) s, (SELECT DISTINCT tech FROM e) t, (SELECT DISTINCT rb FROM e) b, (SELECT DISTINCT day FROM e) d
LEFT JOIN g ON g.scenario = s.scenario AND g.tech = t.tech AND g.rb = b.rb AND g.day = d.day""")
def _(spark, sf):
    d = events(spark, sf, "scenario", "tech", "rb", "day", "value")
    return rounded(agg.densify(d, ["scenario", "tech", "rb", "day"], ["value"]), 2, "value")


def _hist_sql(src, y, by, n, weighted, shared):
    keys = "".join(f"{k}, " for k in by)
    part = "" if shared else f"PARTITION BY {', '.join(by)}"
    lst = ", ".join(by)
    groups = f"(SELECT DISTINCT {keys}l, w FROM b)" if by else "(SELECT DISTINCT l, w FROM b)"
    on = " AND ".join([f"b.{k} = g.{k}" for k in by] + ["b.bin = i.i"])
    val = "sum(b.y)" if weighted else "count(b.y)"
    value = r(f"coalesce({val}, 0)", 2) if weighted else f"CAST({val} AS BIGINT)"
    return f"""
WITH s AS (SELECT {keys}{y} AS y, min({y}) OVER ({part}) AS lo, max({y}) OVER ({part}) AS hi FROM {src}),
e AS (SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS l, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS h FROM s),
f AS (SELECT *, (h - l) / {float(n)} AS w FROM e),
z AS (SELECT *, CAST(least(floor((y - l) / w), {n - 1}) AS INTEGER) AS i0 FROM f),
b AS (SELECT *, i0 - CAST(y < l + i0 * w AS INTEGER) + CAST(i0 < {n - 1} AND y >= l + (i0 + 1) * w AS INTEGER) AS bin FROM z)
SELECT {''.join(f'g.{k} AS {k}, ' for k in by)}{r('g.l + (i.i + 0.5) * g.w')} AS histogram_x, {value} AS {y}
FROM {groups} g CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range({n})) i
LEFT JOIN b ON {on}
GROUP BY {''.join(f'g.{k}, ' for k in by)}g.l, g.w, i.i"""


@query("a13_histogram", _hist_sql("lineitem", "l_extendedprice", [], 20, True, True))
def _(spark, sf):
    d = agg.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20, weighted=True)
    return rounded(rounded(d, 4, "histogram_x"), 2, "l_extendedprice")


@query("a14_histogram_shared_edges", _hist_sql("events", "value", ["event_type"], 25, False, True))
def _(spark, sf):
    return rounded(agg.histogram(table(spark, sf, "events"), "value", 25, ["event_type"]), 4, "histogram_x")


@query("a15_histogram_group_edges", _hist_sql("lineitem", "l_extendedprice", ["l_returnflag", "l_linestatus"], 10, False, False))
def _(spark, sf):
    d = agg.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10, ["l_returnflag", "l_linestatus"], shared_edges=False)
    return rounded(d, 4, "histogram_x")


_Q = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


@query("a16_boxplot", f"""
WITH q AS (SELECT event_type, {', '.join(f'quantile_cont(value, {p}) AS {n}' for n, p in _Q.items())} FROM events GROUP BY 1)
SELECT event_type, {', '.join(f'{r(n)} AS {n}' for n in _Q)}, {r('q75 - q25')} AS iqr, {r('(q25 + q75) / 2', 6)} AS box_center FROM q""")
def _(spark, sf):
    d = prep.boxplot_stats(table(spark, sf, "events"), ["event_type"], "value")
    return rounded(rounded(d, 4, *_Q, "iqr"), 6, "box_center")


@query("a17_between_series_range", f"""
SELECT year, {r('min(y)', 2)} AS range_min, {r('max(y)', 2)} AS range_max
FROM (SELECT year, tech, sum(a) AS y FROM {facts_sql('year', 'tech', 'a')} GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "year", "tech", "a"), ["year", "tech"], "sum(a)", "a")
    return rounded(prep.between_series_range(d, ["year"], "a"), 2, "range_min", "range_max")


@query("a18_net_level", f"""
SELECT *, {r('sum(y) OVER (PARTITION BY rb)', 2)} AS net FROM
(SELECT n_name AS rb, c_mktsegment AS segment, {r('sum(c_acctbal)', 2)} AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def _(spark, sf):
    d = _balances(spark, sf)
    return rounded(prep.net_level(d, "y", ["rb"], "net"), 2, "net")


def _balances(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.groupBy(F.col("n_name").alias("rb"), F.col("c_mktsegment").alias("segment")).agg(F.sum("c_acctbal").alias("y"))
    return rounded(d, 2, "y")


BALANCES = f"(SELECT n_name AS rb, c_mktsegment AS segment, {r('sum(c_acctbal)', 2)} AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


@query("a19_cumulative_sort_key", f"SELECT *, {r('-sum(y) OVER (PARTITION BY rb)', 2)} AS y_cumulative FROM {BALANCES}")
def _(spark, sf):
    return rounded(prep.cumulative_key(_balances(spark, sf), "y", ["rb"], descending=True), 2, "y_cumulative")


@query("a20_axis_bounds_stacked", f"""
SELECT least(0.0, min(n)) AS y_min, greatest(0.0, max(p)) AS y_max FROM (SELECT rb,
{r('sum(CASE WHEN y < 0 THEN y END)', 2)} AS n, {r('sum(CASE WHEN y > 0 THEN y END)', 2)} AS p FROM {BALANCES} GROUP BY 1)""")
def _(spark, sf):
    return rounded(prep.axis_bounds(_balances(spark, sf), None, "y", "segment", stacked=True), 2, "y_min", "y_max")


@query("a20_axis_bounds", f"""
SELECT min(year) - CAST(0.4 AS DOUBLE) AS x_min, max(year) + CAST(0.4 AS DOUBLE) AS x_max, {r('least(0.0, min(y))', 2)} AS y_min, {r('greatest(0.0, max(y))', 2)} AS y_max
FROM (SELECT year, tech, sum(a) AS y FROM {facts_sql('year', 'tech', 'a')} GROUP BY 1, 2)""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "year", "tech", "a"), ["year", "tech"], "sum(a)", "a")
    return rounded(prep.axis_bounds(d, "year", "a", "tech", bar_width=0.8), 2, "y_min", "y_max")


@query("a21_distinct_values", "SELECT DISTINCT p_brand FROM part ORDER BY 1")
def _(spark, sf):
    return agg.distinct_sorted(table(spark, sf, "part"), "p_brand")


@query("a22_drop_duplicates", """
SELECT l_partkey, l_suppkey, l_quantity, l_linestatus FROM (SELECT l_partkey, l_suppkey, l_quantity, l_linestatus,
row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity, l_linestatus) AS n FROM lineitem) WHERE n = 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    return agg.drop_duplicates(d, ["l_partkey", "l_suppkey"])


_COUNTED = ["l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"]


@query("a23_few_valued_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) < 500 AS few FROM lineitem" for c in _COUNTED))
def _(spark, sf):
    d = table(spark, sf, "lineitem")
    few = project.few_valued_columns(d, _COUNTED, 500)
    return spark.createDataFrame([(c, c in few) for c in _COUNTED], "column_name string, few boolean")


_YEARS = list(range(1995, 2002))


@query("a24_pivot_mean", f"""
SELECT tech, {', '.join(f'{r(f"avg(CASE WHEN year = {y} THEN a END)")} AS "{y}"' for y in _YEARS)}
FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1""")
def _(spark, sf):
    d = reshape.pivot_mean(facts(spark, sf, "tech", "year", "a"), ["tech"], "year", "a")
    return rounded(d, 4, *[str(y) for y in _YEARS])


@query("a25_pivot_strict", f"""
SELECT tech, {', '.join(f'{r(f"max(CASE WHEN flag = {chr(39)}{v}{chr(39)} THEN y END)", 2)} AS "{v}"' for v in 'ANR')}
FROM (SELECT tech, flag, sum(a) AS y FROM {facts_sql('tech', 'flag', 'a')} GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "flag", "a"), ["tech", "flag"], "sum(a)", "a")
    return rounded(reshape.pivot_strict(d, ["tech"], "flag", "a", ["A", "N", "R"]), 2, "A", "N", "R")


@query("a26_melt", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def _(spark, sf):
    return reshape.melt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"),
                        ["l_orderkey", "l_linenumber"], None, "measure", "value")


@query("a27_long_to_wide", f"""
SELECT year, month, {', '.join(f"{r(f'sum(CASE WHEN status = {chr(39)}{v}{chr(39)} THEN b END)', 2)} AS {v}" for v in 'FO')}
FROM {facts_sql('year', 'month', 'status', 'b')} GROUP BY 1, 2""")
def _(spark, sf):
    d = agg.sum_over(facts(spark, sf, "year", "month", "status", "b"), ["year", "month", "status"], val_cols=["b"])
    return rounded(reshape.pivot_first(d, ["year", "month"], "status", "b", ["F", "O"]), 2, "F", "O")


@query("a28_named_aggregates", f"SELECT tech, {r('sum(a)', 2)} AS a, {r('sum(b)', 2)} AS b, {r('avg(c)', 6)} AS c FROM {FA} GROUP BY 1")
def _(spark, sf):
    d = agg.named_aggregates(facts(spark, sf, "tech", "a", "b", "c"), ["tech"], {"a": "sum", "b": "sum", "c": "mean"})
    return rounded(rounded(d, 2, "a", "b"), 6, "c")


@query("a29_filtered_sum", f"""
SELECT tech, year, {r('sum(a)', 2)} AS a, {r("coalesce(sum(CASE WHEN NOT (flag = 'A' AND status = 'F') THEN a END), 0)", 2)} AS without_af
FROM {facts_sql('tech', 'year', 'flag', 'status', 'a')} GROUP BY 1, 2""")
def _(spark, sf):
    d = facts(spark, sf, "tech", "year", "flag", "status", "a")
    out = d.groupBy("tech", "year").agg(F.sum("a").alias("a"), agg.filtered_sum(
        "a", ~((F.col("flag") == "A") & (F.col("status") == "F"))).alias("without_af"))
    return rounded(out, 2, "a", "without_af")


@query("a30_share_weighted_sum", f"""
WITH t AS (SELECT rb, segment, sum(a) AS v, sum(b) AS q FROM {facts_sql('rb', 'segment', 'a', 'b')} GROUP BY 1, 2),
s AS (SELECT rb, segment, v / sum(v) OVER (PARTITION BY rb) AS share, q FROM t)
SELECT rb, {r('sum(share * q)')} AS eff FROM s GROUP BY 1""")
def _(spark, sf):
    from longview.operators import windows
    d = agg.sum_over(facts(spark, sf, "rb", "segment", "a", "b"), ["rb", "segment"], val_cols=["a", "b"])
    return rounded(agg.weighted_sum(windows.share(d, "a", ["rb"]), ["rb"], "b", "share", "eff"), 4, "eff")


@query("a31_argmax_rows", """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS k FROM lineitem) WHERE k = 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return agg.argmax_rows(d, ["l_partkey"], "l_quantity")


@query("a32_weighted_mean_price", f"""
WITH w AS (SELECT tech, sum(CASE WHEN flag = 'A' THEN a END) / sum(CASE WHEN flag = 'A' THEN b END) AS pa,
 sum(CASE WHEN flag = 'N' THEN a END) / sum(CASE WHEN flag = 'N' THEN b END) AS pn,
 sum(CASE WHEN flag = 'R' THEN a END) / sum(CASE WHEN flag = 'R' THEN b END) AS pr,
 sum(CASE WHEN flag = 'A' THEN b END) AS qa, sum(CASE WHEN flag = 'N' THEN b END) AS qn, sum(CASE WHEN flag = 'R' THEN b END) AS qr,
 avg(c) AS adder FROM {facts_sql('tech', 'flag', 'a', 'b', 'c')} GROUP BY 1)
SELECT tech, {r('(pa * qa + pn * qn + pr * qr) / (adder * (qa + qn + qr))')} AS gen_price FROM w""")
def _(spark, sf):
    d = facts(spark, sf, "tech", "flag", "a", "b", "c")
    by = F.col("flag")
    def total(c, v):
        return F.sum(F.when(by == v, F.col(c)))
    w = d.groupBy("tech").agg(*[S.ratio(total("a", v), total("b", v)).alias(f"p{v}") for v in "ANR"],
                              *[total("b", v).alias(f"q{v}") for v in "ANR"], F.avg("c").alias("adder"))
    paid = F.col("pA") * F.col("qA") + F.col("pN") * F.col("qN") + F.col("pR") * F.col("qR")
    sold = F.col("qA") + F.col("qN") + F.col("qR")
    return rounded(w.select("tech", S.ratio(paid, F.col("adder") * sold).alias("gen_price")), 4, "gen_price")


# Boundary points: one region per nation, outlines of up to 64 neighbouring customers.
def boundary_points(spark, sf):
    c = table(spark, sf, "customer")
    return prep.planar_points(c.select(
        F.col("c_nationkey").cast("string").alias("id"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("_"), F.floor(F.col("c_custkey") / 64).cast("string")).alias("group"),
        F.col("c_custkey").alias("seq"), (F.lit(-120) + F.col("c_custkey") % 50).alias("long"),
        (F.lit(25) + F.col("c_custkey") % 24).alias("lat"), (F.col("c_acctbal") < -500).alias("hole")))


BOUNDARY = """(SELECT CAST(c_nationkey AS VARCHAR) AS id, concat(c_nationkey, '_', CAST(floor(c_custkey / 64) AS BIGINT)) AS grp, c_custkey AS seq,
(-120 + c_custkey % 50) * 53 AS x, (25 + c_custkey % 24) * 69 AS y, c_acctbal < -500 AS hole FROM customer)"""


@query("a33_map_extent", f"SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM {BOUNDARY} WHERE NOT hole AND id IN (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier)")
def _(spark, sf):
    return prep.map_extent(prep.kept_boundaries(boundary_points(spark, sf), table(spark, sf, "supplier"), "s_nationkey"))


@query("a34_polygons", f"""
SELECT grp AS "group", min(id) AS id, string_agg(concat(x, ' ', y), ';' ORDER BY seq) AS outline FROM {BOUNDARY} WHERE NOT hole GROUP BY 1""")
def _(spark, sf):
    d = prep.polygons(boundary_points(spark, sf).filter(~F.col("hole")))
    text = F.array_join(F.transform("outline", lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ";")
    return d.select("group", "id", text.alias("outline"))


@query("a34_outline_chunks", f"""
WITH p AS (SELECT id AS grp, seq, id, x, y, row_number() OVER (PARTITION BY id ORDER BY seq, x, y) AS n, id AS first FROM {BOUNDARY} WHERE NOT hole),
c AS (SELECT *, (n - 1) // 16 AS chunk FROM p UNION ALL SELECT *, n // 16 FROM p WHERE n % 16 = 0 AND n < (SELECT max(n) FROM p q WHERE q.grp = p.grp))
SELECT grp AS "group", chunk, first AS id, string_agg(concat(x, ' ', y), ';' ORDER BY n) AS outline FROM c GROUP BY 1, 2, 3""")
def _(spark, sf):
    points = boundary_points(spark, sf).filter(~F.col("hole")).withColumn("group", F.col("id"))
    d = prep.outline_chunks(points, size=16, slices=ordered.plan_slices(points, "seq", ["group"], least=6))
    text = F.array_join(F.transform("outline", lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ";")
    return d.select("group", "chunk", "id", text.alias("outline"))


@query("a35_complete_categories", f"""
WITH g AS (SELECT partkey, flag, avg(b) AS b FROM {facts_sql('partkey', 'flag', 'b')} GROUP BY 1, 2)
SELECT p.partkey, f.flag, {r('coalesce(g.b, 0)')} AS b FROM (SELECT DISTINCT partkey FROM g) p CROSS JOIN (SELECT DISTINCT flag FROM g) f
LEFT JOIN g ON g.partkey = p.partkey AND g.flag = f.flag""")
def _(spark, sf):
    return rounded(agg.complete_categories(facts(spark, sf, "partkey", "flag", "b"), ["partkey"], "flag", "b"), 4, "b")


# ---- comparisons ---------------------------------------------------------------------

Y = f"(SELECT scenario, tech, year, sum(a) / 1e6 AS y FROM {facts_sql('scenario', 'tech', 'year', 'a')} GROUP BY 1, 2, 3)"
BASE = "1-URGENT"
REF = f"coalesce(max(CASE WHEN scenario = '{BASE}' THEN y END) OVER (PARTITION BY tech, year), 0)"


def _yearly(spark, sf):
    d = agg.aggregate(facts(spark, sf, "scenario", "tech", "year", "a"), KEYS, "sum(a)", "a")
    return d.select("scenario", "tech", "year", (F.col("a") / 1e6).alias("y"))


def _cmp(name, op, col, base, sql):
    @query(name, sql)
    def run(spark, sf):
        return rounded(compare(_yearly(spark, sf), op, col, base, "y"), 8, "y")
    return run


_cmp("c1_difference_from_base", "Difference", "scenario", BASE,
     f"SELECT scenario, tech, year, {r('y - ref', 8)} AS y FROM (SELECT *, {REF} AS ref FROM {Y}) WHERE scenario <> '{BASE}'")
_cmp("c2_ratio_to_base", "Ratio", "scenario", BASE,
     f"SELECT scenario, tech, year, {r('CASE WHEN ref = 0 THEN 0 ELSE y / ref END', 8)} AS y FROM (SELECT *, {REF} AS ref FROM {Y}) WHERE scenario <> '{BASE}'")
_cmp("c3_difference_consecutive", "Difference", "year", "Consecutive",
     f"SELECT scenario, tech, year, {r('y - ref', 8)} AS y FROM (SELECT *, lag(y) OVER (PARTITION BY scenario, tech ORDER BY year) AS ref FROM {Y}) WHERE ref IS NOT NULL")
_cmp("c4_ratio_consecutive", "Ratio", "year", "Consecutive",
     f"SELECT scenario, tech, year, {r('y / nullif(ref, 0)', 8)} AS y FROM (SELECT *, lag(y) OVER (PARTITION BY scenario, tech ORDER BY year) AS ref FROM {Y}) WHERE ref IS NOT NULL")
_cmp("c5_difference_from_total", "Difference", "tech", "Total",
     f"SELECT scenario, tech, year, {r('y - sum(y) OVER (PARTITION BY scenario, year)', 8)} AS y FROM {Y}")
_cmp("c6_share_of_total", "Ratio", "tech", "Total",
     f"SELECT scenario, tech, year, {r('y / nullif(sum(y) OVER (PARTITION BY scenario, year), 0)', 8)} AS y FROM {Y}")


@query("c7_cleanup_after_comparison", f"""
WITH p AS (SELECT l_partkey AS partkey, l_returnflag AS flag, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, coalesce(max(CASE WHEN flag = 'A' THEN y END) OVER (PARTITION BY partkey), 0) AS ref FROM p)
SELECT partkey, flag, {r('CASE WHEN ref = 0 THEN 0 ELSE y / ref END', 6)} AS y FROM c WHERE flag <> 'A'""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("partkey"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("y"))
    return rounded(compare(d, "Ratio", "flag", "A", "y"), 6, "y")


@query("c8_chained_comparisons", f"""
WITH s1 AS (SELECT scenario, tech, year, y / nullif(sum(y) OVER (PARTITION BY scenario, year), 0) AS y FROM {Y}),
s2 AS (SELECT scenario, tech, year, y - lag(y) OVER (PARTITION BY scenario, tech ORDER BY year) AS y FROM s1),
s3 AS (SELECT *, {REF} AS ref FROM s2 WHERE y IS NOT NULL)
SELECT scenario, tech, year, {r('y - ref', 8)} AS y FROM s3 WHERE scenario <> '{BASE}'""")
def _(spark, sf):
    steps = [("Ratio", "tech", "Total"), ("Difference", "year", "Consecutive"), ("Difference", "scenario", BASE)]
    return rounded(compare_chain(_yearly(spark, sf), steps, "y"), 8, "y")


@query("c3_consecutive_across_users", f"""
WITH u AS (SELECT event_type, user_id, sum(value) AS y FROM events GROUP BY 1, 2)
SELECT event_type, user_id, {r('y - ref', 2)} AS y FROM (SELECT *, lag(y) OVER (PARTITION BY event_type ORDER BY user_id) AS ref FROM u) WHERE ref IS NOT NULL""")
def _(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("y"))
    return rounded(compare(d, "Difference", "user_id", "Consecutive", "y"), 2, "y")


# ---- set operations ------------------------------------------------------------------

@query("u1_union_by_name", """
SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return reshape.union_by_name(c, s)


@query("u2_union_with_total", f"""
WITH g AS (SELECT tech, year, sum(a) AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1, 2)
SELECT tech, year, {r('a', 2)} AS a FROM g UNION ALL SELECT 'tot', year, {r('sum(a)', 2)} FROM g GROUP BY year""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "a"), ["tech", "year"], "sum(a)", "a")
    return rounded(reshape.add_total(d, ["year"], "a", {"tech": "tot"}), 2, "a")


@query("u3_distinct_projection", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(spark, sf):
    return agg.drop_duplicates(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"))


@query("u4_side_by_side", f"""
SELECT year, {r("coalesce(sum(CASE WHEN flag = 'A' THEN b END), 0)", 2)} AS returned, {r("coalesce(sum(CASE WHEN status = 'F' AND flag = 'N' THEN b END), 0)", 2)} AS kept
FROM {facts_sql('year', 'flag', 'status', 'b')} WHERE flag = 'A' OR (status = 'F' AND flag = 'N') GROUP BY 1""")
def _(spark, sf):
    d = facts(spark, sf, "year", "flag", "status", "b")
    one = d.filter("flag = 'A'").groupBy("year").agg(F.sum("b").alias("returned"))
    two = d.filter("flag = 'N' and status = 'F'").groupBy("year").agg(F.sum("b").alias("kept"))
    return rounded(reshape.side_by_side("year", [one, two]), 2, "returned", "kept")


@query("u5_mapping_with_identity", """
SELECT rs, r FROM (SELECT DISTINCT p_name AS rs, min(p_brand) OVER (PARTITION BY p_name) AS r FROM part)
UNION SELECT b, b FROM (SELECT DISTINCT p_brand AS b FROM part) WHERE b NOT IN (SELECT p_name FROM part)""")
def _(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_name").alias("rs"), F.col("p_brand").alias("r"))
    return reshape.with_identity(d, "rs", "r")
