"""Filters, projections, roles (P) and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate as agg
from longview.operators import joins, prep, project, ranking, windows
from longview.operators.compare import compare
from workload.facts import events, events_sql, facts, facts_sql, table
from workload.q_aggregate import boundary_points
from workload.registry import query, r, rounded

YT = f"(SELECT tech, year, sum(a) AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1, 2)"


@query("p1_filter_in_lists", f"""
SELECT tech, flag, year, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'flag', 'year', 'a')}
WHERE tech IN ('SMALL', 'LARGE') AND flag IN ('A', 'R') AND year IN (1996, 1998) GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = project.apply_filters(facts(spark, sf, "tech", "flag", "year", "a"),
                              {"tech": ["SMALL", "LARGE"], "flag": ["A", "R"], "year": ["1996", "1998"]})
    return rounded(agg.aggregate(d, ["tech", "flag", "year"], "sum(a)", "a"), 2, "a")


@query("p2_filter_last", f"""
WITH f AS {facts_sql('flag', 'year', 'month', 'a')}
SELECT flag, month, {r('sum(a)', 2)} AS a FROM f WHERE year = (SELECT max(year) FROM f) GROUP BY 1, 2""")
def _(spark, sf):
    d = project.apply_filters(facts(spark, sf, "flag", "year", "month", "a"), {"year": "last"})
    return rounded(agg.aggregate(d, ["flag", "month"], "sum(a)", "a"), 2, "a")


@query("p3_filter_range_exclude", f"""
SELECT year, brand, {r('sum(b)', 2)} AS b FROM {facts_sql('year', 'brand', 'b')}
WHERE year BETWEEN 1996 AND 1999 AND year <> 1998 AND brand BETWEEN 'Brand#10' AND 'Brand#2' AND brand NOT IN ('Brand#12') GROUP BY 1, 2""")
def _(spark, sf):
    d = project.apply_filters(facts(spark, sf, "year", "brand", "b"), {
        "year": {"start": 1996, "end": 1999, "exclude": [1998]},
        "brand": {"start": "Brand#10", "end": "Brand#2", "exclude": ["Brand#12"]}})
    return rounded(agg.aggregate(d, ["year", "brand"], "sum(a)", "b"), 2, "b")


@query("p4_filter_unknown_values", f"SELECT line, {r('sum(b)', 2)} AS b FROM {facts_sql('line', 'b')} WHERE line IN (1, 3) GROUP BY 1")
def _(spark, sf):
    d = project.apply_filters(facts(spark, sf, "line", "b"), {"line": ["1", "3", "99", "none"], "absent": ["x"]})
    return rounded(agg.aggregate(d, ["line"], "sum(a)", "b"), 2, "b")


@query("p5_empty_selection", f"SELECT tech, year, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'year', 'a')} WHERE tech = 'nothing' GROUP BY 1, 2")
def _(spark, sf):
    d = project.apply_filters(facts(spark, sf, "tech", "year", "a"), {"tech": ["nothing"]})
    return rounded(agg.aggregate(d, ["tech", "year"], "sum(a)", "a"), 2, "a")


@query("p6_drop_before_grouping", f"SELECT tech, year, {r('sum(a)', 2)} AS a, {r('sum(b)', 2)} AS b FROM {facts_sql('tech', 'year', 'a', 'b')} GROUP BY 1, 2")
def _(spark, sf):
    d = facts(spark, sf, "tech", "year", "month", "flag", "a", "b")
    return rounded(agg.sum_over(d, ["tech", "year"], drop_cols=["month", "flag", "absent"]), 2, "a", "b")


@query("p7_scale_column", f"SELECT tech, year, {r('sum(a) * 1e-6', 8)} AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1, 2")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "a"), ["tech", "year"], "sum(a)", "a")
    return rounded(project.scale(d, "a", 1e-6), 8, "a")


@query("p8_scale_filtered", f"SELECT tech, year, {r('''sum(a) * CASE WHEN tech IN ('PROMO', 'SMALL') THEN 1e-3 ELSE 1 END''', 2)} AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1, 2")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "a"), ["tech", "year"], "sum(a)", "a")
    return rounded(project.scale(d, "a", 1e-3, "tech", ["PROMO", "SMALL"]), 2, "a")


@query("p9_scale_axes", f"SELECT year * CAST(0.1 AS DOUBLE) AS year, {r('sum(a) * 0.001', 5)} AS a FROM {facts_sql('year', 'a')} GROUP BY facts.year".replace(f"{facts_sql('year', 'a')}", f"{facts_sql('year', 'a')} facts"))
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "year", "a"), ["year"], "sum(a)", "a")
    return rounded(project.scale(project.scale(d, "year", 0.1), "a", 0.001), 5, "a")


@query("p10_column_order", f"SELECT flag, tech, year, {r('sum(a)', 2)} AS a FROM {facts_sql('flag', 'tech', 'year', 'a')} GROUP BY 1, 2, 3")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "flag", "tech", "year", "a"), ["year", "flag", "tech"], "sum(a)", "a")
    return rounded(project.order_columns(d, ["tech", "year"], "a"), 2, "a")


@query("p11_fill_by_role", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN '{BLANK}' ELSE l_returnflag END AS flag,
CASE WHEN l_quantity > 40 THEN 0 ELSE l_quantity END AS quantity FROM lineitem""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, 'N')").alias("flag"),
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("quantity"))
    return project.fill_by_role(d)


def _roles_frame(spark, roles):
    names = ["discrete", "continuous", "x-axis", "y-axis", "filterable", "seriesable"]
    rows = [(c, *[c in roles[n] for n in names]) for c in roles["all"]]
    return spark.createDataFrame(rows, "column_name string, " + ", ".join(f"`{n.replace('-', '_')}` boolean" for n in names))


@query("p12_column_roles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {d} AS discrete, NOT {d} AS continuous, true AS x_axis, NOT {d} AS y_axis, {f} AS filterable, {f} AS seriesable FROM lineitem"
    for c, d, f in [("l_returnflag", "true", "true OR count(*) > 0"), ("l_quantity", "false", "false AND count(*) > 0"),
                    ("l_linenumber", "false", "count(DISTINCT l_linenumber) < 500"), ("l_orderkey", "false", "count(DISTINCT l_orderkey) < 500"),
                    ("l_suppkey", "false", "count(DISTINCT l_suppkey) < 500")]))
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_linenumber", "l_orderkey", "l_suppkey")
    return _roles_frame(spark, project.column_roles(d))


META = {"year": {"type": "number", "filterable": True, "seriesable": True, "y-allow": False},
        "icrb": {"type": "string", "filterable": False, "seriesable": False}}


@query("p13_roles_from_metadata", f"""
SELECT tech || ' ' || year AS k, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1""")
def _(spark, sf):
    d = facts(spark, sf, "tech", "year", "a").withColumn("icrb", F.col("tech"))
    roles = project.roles_from_meta(d, META)
    keys, values = roles["seriesable"], roles["y-axis"]
    out = d.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    return rounded(out.select(S.join_text(" ", *keys).alias("k"), *values), 2, *values)


@query("p14_type_coercion", """
SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#1', '1') AS DOUBLE) AS code, CAST(p_size AS VARCHAR) AS size FROM part""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#1"), F.lit("1")).alias("code"), F.col("p_size").alias("size"))
    return project.coerce_types(d, {"code": {"type": "number"}, "size": {"type": "string"}})


@query("p15_infinities_to_null", """
SELECT flag, tech, y FROM (SELECT flag, tech, round(p / nullif(z, 0), 6) + 0.0 AS y FROM
(SELECT l_returnflag AS flag, l_partkey AS tech, sum(l_quantity) AS p, sum(CASE WHEN l_discount > 0.08 THEN l_quantity ELSE 0 END) AS z FROM lineitem GROUP BY 1, 2)) WHERE y IS NOT NULL""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("tech")).agg(
        F.sum("l_quantity").alias("p"), F.sum(F.when(F.col("l_discount") > 0.08, F.col("l_quantity")).otherwise(0)).alias("z"))
    return rounded(d.select("flag", "tech", S.ratio("p", "z").alias("y")).filter(F.col("y").isNotNull()), 6, "y")


@query("p16_drop_zeros", f"SELECT * FROM (SELECT tech, hour, {r('''sum(CASE WHEN value > 300 THEN value ELSE 0 END)''', 2)} AS value FROM {events_sql('tech', 'hour', 'value')} GROUP BY 1, 2) WHERE value <> 0")
def _(spark, sf):
    d = events(spark, sf, "tech", "hour", "value").withColumn("value", F.when(F.col("value") > 300, F.col("value")).otherwise(0))
    return project.drop_zeros(rounded(agg.aggregate(d, ["tech", "hour"], "sum(a)", "value"), 2, "value"), "value")


@query("p17_kept_boundaries", """
SELECT CAST(c_nationkey AS VARCHAR) AS id, count(*) AS points FROM customer
WHERE NOT c_acctbal < -500 AND c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1""")
def _(spark, sf):
    d = prep.kept_boundaries(boundary_points(spark, sf), table(spark, sf, "supplier"), "s_nationkey")
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("points"))


@query("p18_group_label", f"SELECT tech || ' ' || year AS tech_year, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "a"), ["tech", "year"], "sum(a)", "a")
    return rounded(project.group_label(d, "tech", "year").select("tech_year", "a"), 2, "a")


@query("p19_composite_key", "SELECT p_partkey, p_brand || ' | ' || nullif(p_type, 'PROMO') || ' | ' || p_size AS k FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.join_text(" | ", "p_brand", F.expr("nullif(p_type, 'PROMO')"), "p_size").alias("k"))


@query("p20_threshold_flags", """
SELECT c_custkey, CASE WHEN c_acctbal > 0.001 THEN 'yes' ELSE 'no' END AS available, CASE WHEN nullif(c_acctbal, 0) <> 0 THEN 'yes' ELSE 'no' END AS chosen FROM customer""")
def _(spark, sf):
    d = table(spark, sf, "customer")
    d = project.flag(project.flag(d, "available", F.col("c_acctbal") > 0.001), "chosen", F.expr("nullif(c_acctbal, 0) <> 0"))
    return d.select("c_custkey", "available", "chosen")


@query("p21_drop_region_prefix", "SELECT p_partkey, p_type AS rs FROM part WHERE p_type NOT LIKE 'S%'")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("region"))
    return project.drop_region_prefix(d, "region", "S", "rs")


@query("p22_conditional_updates", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity + 0.35 * l_tax
WHEN l_returnflag = 'N' THEN l_quantity + l_discount + 0.65 * l_tax ELSE l_quantity END, 6) AS q FROM lineitem""")
def _(spark, sf):
    flag, q = F.col("l_returnflag"), F.col("q")
    d = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity"))
    d = project.update_where(d, "q", [((flag == "A") & (F.col("l_linestatus") == "F"), q + 0.35 * F.col("l_tax")),
                                      (flag == "N", q + F.col("l_discount") + 0.65 * F.col("l_tax"))])
    return rounded(d.select("l_orderkey", "l_linenumber", "q"), 6, "q")


@query("p23_row_selection", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#4'")
def _(spark, sf):
    return table(spark, sf, "part").filter((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#4")).select("p_partkey", "p_name")


@query("p24_flip_flows", f"""
WITH f AS (SELECT concat(s_nationkey, '-', c_nationkey) AS pair, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS y
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT CASE WHEN y < 0 THEN concat(split_part(pair, '-', 2), '-', split_part(pair, '-', 1)) ELSE pair END AS pair, {r('abs(y)', 2)} AS y FROM f""")
def _(spark, sf):
    return rounded(project.flip_flows(nation_flows(spark, sf), "pair", "y"), 2, "y")


def nation_flows(spark, sf):
    d = (table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
         .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")))
    value = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return d.groupBy(S.join_text("-", "s_nationkey", "c_nationkey").alias("pair")).agg(F.sum(value).alias("y"))


@query("p25_drop_flat_segments", f"SELECT * FROM (SELECT tech, hour, {r('sum(CASE WHEN value > 250 THEN value ELSE 0 END)', 2)} AS h FROM {events_sql('tech', 'hour', 'value')} GROUP BY 1, 2) WHERE abs(h) > 1e-13")
def _(spark, sf):
    d = events(spark, sf, "tech", "hour", "value").groupBy("tech", "hour").agg(F.sum(F.when(F.col("value") > 250, F.col("value")).otherwise(0)).alias("h"))
    return project.drop_flat(rounded(d, 2, "h"), "h")


@query("p26_drop_nulls", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax <> 0 AND l_returnflag <> 'N'")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_tax, 0)").alias("l_tax"), F.expr("nullif(l_returnflag, 'N')").alias("f"))
    return d.dropna().drop("f")


@query("p27_positional_rename", "SELECT r_regionkey AS k, r_name AS region, n_name AS area FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def _(spark, sf):
    d = (table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
         .join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("r_regionkey", "r_name", "n_name"))
    return project.rename_all(d, ["k", "region", "area"])


@query("p28_year_cut_zero_last", f"""
WITH g AS (SELECT * FROM {YT} WHERE year BETWEEN 1996 AND 2000)
SELECT tech, year, {r('CASE WHEN year = (SELECT max(year) FROM g) THEN 0 ELSE a END', 2)} AS a FROM g""")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "a"), ["tech", "year"], "sum(a)", "a").filter(F.col("year").between(1996, 2000))
    return rounded(project.zero_last_year(d, "a"), 2, "a")


@query("p29_code_substitution", f"SELECT CASE WHEN tech = 'PROMO' THEN 'ECONOMY' ELSE tech END AS tech, {r('sum(a)', 2)} AS a FROM {facts_sql('tech', 'a')} x GROUP BY 1")
def _(spark, sf):
    d = facts(spark, sf, "tech", "a").withColumn("tech", S.replace_value("tech", "PROMO", "ECONOMY"))
    return rounded(agg.aggregate(d, ["tech"], "sum(a)", "a"), 2, "a")


@query("p30_null_aware_predicate", """
SELECT p_partkey, p_type, nullif(p_brand, 'Brand#1') AS device FROM part WHERE NOT (p_type = 'SMALL' AND nullif(p_brand, 'Brand#1') IS NULL)""")
def _(spark, sf):
    from longview.plans.demand.devices import without_unmodelled
    d = table(spark, sf, "part").select("p_partkey", F.col("p_type"), F.expr("nullif(p_brand, 'Brand#1')").alias("device"),
                                        F.expr("CASE WHEN p_type = 'SMALL' THEN 'EL' ELSE 'NG' END").alias("fuel"))
    return without_unmodelled(d).drop("fuel")


# ---- scalar functions ----------------------------------------------------------------

@query("f1_lower", "SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type FROM part")
def _(spark, sf):
    return project.lowercase_strings(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"))


@query("f2_split_parts", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS code, split_part(o_orderpriority, '-', 2) AS name, list_extract(string_split(o_orderpriority, '-'), -1) AS tail FROM orders")
def _(spark, sf):
    p = "o_orderpriority"
    return table(spark, sf, "orders").select("o_orderkey", S.part(p, "-", 0).alias("code"), S.part(p, "-", 1).alias("name"), S.last_part(p, "-").alias("tail"))


@query("f3_text_tests", "SELECT p_partkey, contains(p_name, 'ring') AS has, regexp_matches(p_name, 'red|blue') AS either, starts_with(p_type, 'S') AS s FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").contains("ring").alias("has"), F.col("p_name").rlike("red|blue").alias("either"), F.col("p_type").startswith("S").alias("s"))


@query("f4_class_suffix", "SELECT n_name, CASE WHEN n_name LIKE '%\\_%' ESCAPE '\\' THEN 'class_' || split_part(n_name, '_', 2) END AS class, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name", S.class_of("n_name").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("f5_replace", "SELECT c_custkey, regexp_replace(c_name, '#0+', ' ') AS a, replace(c_mktsegment, 'ING', '.') AS b FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_replace("c_name", "#0+", " ").alias("a"), F.replace("c_mktsegment", F.lit("ING"), F.lit(".")).alias("b"))


@query("f6_substring", "SELECT c_custkey, substring(c_name, 10, 6) AS a, substring(c_name, 1, 3) AS b FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 6).alias("a"), F.substring("c_name", 1, 3).alias("b"))


@query("f7_trim", "SELECT p_partkey, trim(substring(p_name, 1, 5)) AS a FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.trim(F.substring("p_name", 1, 5)).alias("a"))


@query("f8_zero_pad", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 3, '0') AS a, CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 3 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 3, '0') END AS b FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.format_string("%03d", "p_size").alias("a"), S.zero_pad("p_partkey", 3).alias("b"))


@query("f9_prefix", "SELECT s_suppkey, concat('p', s_nationkey) AS ba FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("ba"))


@query("f10_strip_leading_zeros", "SELECT c_custkey, ltrim(substring(c_name, 10), '0') AS a FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.strip_leading_zeros(F.substring("c_name", 10, 20)).alias("a"))


@query("f11_abs_sign", "SELECT c_custkey, abs(c_acctbal) AS a, c_acctbal < 0 AS negative FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.abs("c_acctbal").alias("a"), (F.col("c_acctbal") < 0).alias("negative"))


@query("f12_inflation", f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice / 0.697349107')} AS a FROM lineitem")
def _(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.inflate("l_extendedprice", 2021).alias("a")), 4, "a")


@query("f13_discount", f"SELECT orderkey, line, {r('a / power(1.05, year - 2022)', 3)} AS a FROM {facts_sql('orderkey', 'line', 'year', 'a')}")
def _(spark, sf):
    return rounded(facts(spark, sf, "orderkey", "line", "year", "a").select("orderkey", "line", S.discount("a", "year").alias("a")), 3, "a")


@query("f14_capital_recovery", f"SELECT tech, {r('sum(a) / 1e6 * 0.05 * power(1.05, 20) / (power(1.05, 20) - 1)', 6)} AS a FROM {facts_sql('tech', 'a')} GROUP BY 1")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "a"), ["tech"], "sum(a)", "a")
    return rounded(d.withColumn("a", F.col("a") / 1e6 * S.capital_recovery_factor(0.05, 20)), 6, "a")


@query("f15_weibull", f"""
SELECT p_partkey, {r('1 - exp(-power(p_size / 20.0, 1.5))', 8)} AS gone, {r('CASE WHEN exp(-power(p_size / 5.0, 2.5)) < 0.001 THEN 0 ELSE exp(-power(p_size / 5.0, 2.5)) END', 8)} AS kept FROM part""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", S.weibull_cdf("p_size", F.lit(1.5), F.lit(20)).alias("gone"), S.survival("p_size", F.lit(2.5), F.lit(5)).alias("kept"))
    return rounded(d, 8, "gone", "kept")


@query("f16_round_significant", """
SELECT c_custkey, CAST(CASE WHEN abs(d) >= 1000 THEN round(d, -1) WHEN abs(d) >= 100 THEN round(d, 0) WHEN abs(d) >= 10 THEN round(d, 1) ELSE d END AS DOUBLE) AS a
FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18, 2)) AS d FROM customer)""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.round_significant("c_acctbal", 3).alias("a"))


@query("f17_short_number", """
SELECT l_orderkey, l_linenumber, format('{:.2E}', l_extendedprice * 1000) AS big, format('{:.2E}', l_quantity / 1e6) AS small, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS plain FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.short_number(F.col("l_extendedprice") * 1000).alias("big"),
                                               S.short_number(F.col("l_quantity") / 1e6).alias("small"), S.short_number("l_quantity").alias("plain"))


@query("f18_infinity_to_null", f"SELECT l_orderkey, l_linenumber, {r('l_quantity / nullif(l_discount, 0)')} AS a FROM lineitem")
def _(spark, sf):
    # A division that yields infinity, cleaned afterwards.
    raw = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("l_quantity"), F.col("l_discount")))
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.finite(raw).alias("a")), 4, "a")


@query("f19_text_to_number", "SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS a, TRY_CAST(o_orderpriority AS DOUBLE) AS b FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.to_number(F.substring("o_orderpriority", 1, 1)).alias("a"), S.to_number("o_orderpriority").alias("b"))


@query("f20_value_replace", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 2000 ELSE p_size END AS size FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.replace_value("p_size", 1, 2000).alias("size"))


@query("f21_unit_constants", f"SELECT l_orderkey, l_linenumber, {r('l_quantity / (l_extendedprice * 8760)', 12)} AS cf, {r('l_quantity / 1.60934 / 1000', 8)} AS gwmi, {r('l_quantity * 0.29329722222222', 6)} AS mwh FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.ratio(q, F.col("l_extendedprice") * S.HOURS_PER_YEAR).alias("cf"),
                                            (q / S.KM_PER_MILE / 1000).alias("gwmi"), (q * S.MWH_PER_MMBTU).alias("mwh"))
    return rounded(rounded(rounded(d, 12, "cf"), 8, "gwmi"), 6, "mwh")


@query("f22_planar_coordinates", "SELECT c_custkey, (-120 + c_custkey % 50) * 53 AS x, (25 + c_custkey % 24) * 69 AS y, round((-120 + c_custkey % 50) * 53 + CAST(0.8 AS DOUBLE) * ((25 + c_custkey % 24) * 69 - (-120 + c_custkey % 50) * 53), 6) AS tip FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    x, y = S.planar(F.lit(-120) + k % 50, F.lit(25) + k % 24)
    d = table(spark, sf, "customer").select("c_custkey", x.alias("x"), y.alias("y"))
    return d.select("*", F.round(S.along("x", "y", 0.8), 6).alias("tip"))


@query("f23_range_label", "SELECT p_partkey, concat(p_size - 1, ' to ', p_size + 1) AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.range_label(F.col("p_size") - 1, F.col("p_size") + 1).alias("label"))
