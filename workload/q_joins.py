"""Lookups and joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate as agg
from longview.operators import joins, prep, project
from longview.plans.demand import hourly
from workload.facts import events, events_sql, facts, facts_sql, table
from workload.q_aggregate import BOUNDARY, boundary_points
from workload.q_project import nation_flows
from workload.registry import query, r, rounded


@query("j1_attribute_join", """
WITH l AS (SELECT p_brand, min(struct_pack(t := p_type, s := p_size)) AS x FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1)
SELECT p_partkey, p_brand, x.t AS tech, x.s AS size FROM part JOIN l USING (p_brand)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    lookup = part.filter("p_brand <> 'Brand#7'").select("p_partkey", "p_brand", F.col("p_type").alias("tech"), F.col("p_size").alias("size"))
    return joins.join_attributes(part.select("p_partkey", "p_brand"), lookup, "p_brand")


@query("j2_value_map", """
WITH m AS (SELECT p_type AS raw, max_by(p_brand, p_partkey) AS display FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(display, p_type) AS tech FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN m ON raw = p_type""")
def _(spark, sf):
    part = table(spark, sf, "part")
    mapping = part.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("raw"), F.col("p_brand").alias("display"), "p_partkey")
    d = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_type").alias("tech"))
    return joins.map_values(d, "tech", mapping, seq="p_partkey")


@query("j2_value_map_literal", f"SELECT CASE tech WHEN 'PROMO' THEN 'Sale' WHEN 'SMALL' THEN 'Sale' ELSE tech END AS tech, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'a')} x GROUP BY 1")
def _(spark, sf):
    d = joins.map_values(facts(spark, sf, "tech", "a"), "tech", {"PROMO": "Sale", "SMALL": "Sale"})
    return rounded(agg.aggregate(d, ["tech"], "sum(a)", "a"), 2, "a")


@query("j3_left_join_fill", """
SELECT o_orderkey, coalesce(q, 0.0) AS q FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, sf):
    q = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return joins.left_fill(table(spark, sf, "orders").select("o_orderkey"), q, ["o_orderkey"], "q", 0.0)


@query("j4_outer_join_fill", """
WITH a AS (SELECT l_partkey AS k, l_suppkey AS s, sum(l_quantity) AS gen FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
b AS (SELECT l_partkey AS k, l_suppkey AS s, sum(l_quantity) AS uncurt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT k, s, coalesce(gen, 0) AS gen, coalesce(uncurt, gen) AS uncurt FROM a FULL JOIN b USING (k, s)""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), "l_returnflag", "l_quantity")
    a = d.filter("l_returnflag = 'A'").groupBy("k", "s").agg(F.sum("l_quantity").alias("gen"))
    b = d.filter("l_returnflag = 'R'").groupBy("k", "s").agg(F.sum("l_quantity").alias("uncurt"))
    return joins.outer_fill(a, b, ["k", "s"], {"gen": 0.0, "uncurt": "gen"})


@query("j5_inner_join_suffixes", """
SELECT a.k AS k, a.v AS v_x, b.v AS v_y FROM (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1) a
JOIN (SELECT p_partkey AS k, p_retailprice AS v FROM part) b ON a.k = b.k""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return joins.join_suffixed(a, table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), ["k"])


@query("j6_left_join_other_names", "SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    return joins.left_on(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer"), "o_custkey", "c_custkey", {"c_mktsegment": "segment"})


@query("j7_product_with_small_table", "SELECT p_partkey, r_name FROM part CROSS JOIN region")
def _(spark, sf):
    return joins.expand_by(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "region").select("r_name"))


@query("j8_year_range_expansion", """
SELECT o_orderkey, CAST(y AS INTEGER) AS year FROM (SELECT o_orderkey, unnest(range(year(o_orderdate), 2002)) AS y FROM orders) WHERE y >= 1997""")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("first"), F.lit(2001).alias("last"))
    return joins.within_years(d, "first", "last", 1997, 2010).drop("first", "last")


@query("j9_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.keep_members(table(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("j10_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.drop_members(table(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("j11_unmapped_values", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def _(spark, sf):
    return joins.unmapped(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").filter("p_size < 40"), "p_partkey")


@query("j12_base_value_beside_rows", f"""
WITH g AS (SELECT scenario, tech, {r('sum(a)', 2)} AS a FROM {facts_sql('scenario', 'tech', 'a')} GROUP BY 1, 2)
SELECT *, max(CASE WHEN scenario = '1-URGENT' THEN a END) OVER (PARTITION BY tech) AS base FROM g""")
def _(spark, sf):
    from longview.operators.common import attach
    d = rounded(agg.aggregate(facts(spark, sf, "scenario", "tech", "a"), ["scenario", "tech"], "sum(a)", "a"), 2, "a")
    base = d.groupBy("tech").agg(F.max(F.when(F.col("scenario") == "1-URGENT", F.col("a"))).alias("base"))
    return attach(d, ["tech"], base, ["base"])


@query("j13_link_endpoints", f"""
WITH f AS (SELECT concat(s_nationkey, '-', c_nationkey) AS pair, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS y
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
c AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey * 53 AS x, n_regionkey * 69 AS y FROM nation)
SELECT pair, {r('f.y', 2)} AS y, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y, round(a.x + CAST(0.8 AS DOUBLE) * (b.x - a.x), 4) AS arrow_x, round(a.y + CAST(0.8 AS DOUBLE) * (b.y - a.y), 4) AS arrow_y
FROM f LEFT JOIN c a ON a.id = split_part(pair, '-', 1) LEFT JOIN c b ON b.id = split_part(pair, '-', 2)""")
def _(spark, sf):
    c = prep.planar_points(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").alias("long"), F.col("n_regionkey").alias("lat")))
    d = prep.arrow_ends(joins.link_endpoints(nation_flows(spark, sf), "pair", c), 0.8).drop("from", "to")
    return rounded(rounded(d, 2, "y"), 4, "arrow_x", "arrow_y")


@query("j14_natural_join", "SELECT nationkey, c_custkey, suppliers FROM (SELECT c_nationkey AS nationkey, c_custkey FROM customer) JOIN (SELECT s_nationkey AS nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) USING (nationkey)")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), "c_custkey")
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))  # one row per key
    return joins.natural_join(a, b, "inner")


@query("j15_sector_bind_by_key", f"""
WITH e AS {events_sql('rb', 'year', 'hour', 'tech', 'value')}, g AS (SELECT rb AS ba, year, hour, tech, sum(value) AS v FROM e GROUP BY 1, 2, 3, 4)
SELECT ba, year, hour, {r('sum(v)', 2)} AS value FROM g GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(DISTINCT tech) FROM g)""")
def _(spark, sf):
    kinds = sorted(x[0] for x in table(spark, sf, "events").select("event_type").distinct().collect())  # the sectors: a handful
    return rounded(hourly.sector_total(*[sector(spark, sf, t) for t in kinds]), 2, "value")


def sector(spark, sf, tech):
    d = events(spark, sf, "rb", "year", "hour", "tech", "value").filter(F.col("tech") == tech)
    return d.groupBy(F.col("rb").alias("ba"), "year", "hour").agg(F.sum("value").alias("value"))


@query("j16_backfill_from_reference", f"""
WITH g AS (SELECT tech, year, sum(a) AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1, 2)
SELECT tech, year, {r('a', 2)} AS a FROM g WHERE year NOT IN (1995, 1996) UNION ALL
SELECT tech, CAST(y AS INTEGER), {r('a', 2)} FROM g CROSS JOIN (VALUES (1995), (1996)) v(y) WHERE year = 1997""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "a"), ["tech", "year"], "sum(a)", "a")
    return rounded(joins.complete_from_reference(d, 1997, [1995, 1996]), 2, "a")


@query("j17_regions_with_values", f"""
WITH v AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, CAST(count(*) AS VARCHAR) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY 1)
SELECT b.id, seq, coalesce(n, 'NA') AS n FROM {BOUNDARY} b LEFT JOIN v ON v.id = b.id""")
def _(spark, sf):
    values = table(spark, sf, "supplier").filter("s_acctbal > 3000").groupBy(F.col("s_nationkey").cast("string").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return joins.regions_with_values(boundary_points(spark, sf), values, "region", "n").select("id", "seq", "n")
