"""Chart and map data of whole views (V), and the chain from a result to a view."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.operators import aggregate as agg
from longview.operators import joins, prep
from longview.plans import view
from longview.sources import scenarios
from workload.facts import facts, facts_sql, table
from workload.registry import query, r, rounded

BY_YEAR = f"(SELECT scenario, tech, year, sum(a) AS a FROM {facts_sql('scenario', 'tech', 'year', 'a')} GROUP BY 1, 2, 3)"


@query("v1_stacked_chart", f"""
WITH g AS {BY_YEAR}, f AS (SELECT scenario, year, tech, coalesce(a, 0) AS a FROM (SELECT DISTINCT scenario, year FROM g) JOIN (SELECT DISTINCT scenario, tech FROM g) USING (scenario) LEFT JOIN g USING (scenario, year, tech))
SELECT scenario, tech, year, {r('a', 2)} AS a, {r('top - a', 2)} AS base_pos, {r('top', 2)} AS top_pos FROM (SELECT *, sum(a) OVER (PARTITION BY scenario, year ORDER BY tech) AS top FROM f)""")
def _(spark, sf):
    spec = {"x": "year", "y": "a", "series": "tech", "explode": "scenario", "chart_type": "Area"}
    d = view.chart_view(facts(spark, sf, "scenario", "tech", "year", "a"), spec)
    return rounded(d.select("scenario", "tech", "year", "a", "base_pos", "top_pos"), 2, "a", "base_pos", "top_pos")


@query("v2_box_plot_chart", f"""
SELECT year, {', '.join(f"{r(f'quantile_cont(a, {p})', 4)} AS q{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM {facts_sql('year', 'a')} GROUP BY 1""")
def _(spark, sf):
    d = view.chart_view(facts(spark, sf, "year", "a"), {"x": "year", "y": "a", "y_agg": None, "range": "Boxplot"})
    return rounded(d.select("year", *prep.BOX_PROBS), 4, *prep.BOX_PROBS)


@query("v3_between_series_chart", f"SELECT scenario, year, {r('min(a)', 2)} AS range_min, {r('max(a)', 2)} AS range_max FROM {BY_YEAR} GROUP BY 1, 2")
def _(spark, sf):
    spec = {"x": "year", "y": "a", "series": "tech", "explode": "scenario", "chart_type": "Line", "range": "Between Series"}
    d = view.chart_view(facts(spark, sf, "scenario", "tech", "year", "a"), spec)
    return rounded(d, 2, "range_min", "range_max")


# Sums carry two decimals, so that millions carry eight: rounded there, no value lies between two results.
REVENUE = f"(SELECT rb, sum(a) * 1e-6 AS a FROM {facts_sql('rb', 'a')} GROUP BY 1)"
CENTROIDS = "(SELECT n_name AS id, n_nationkey * 2.0 - 120 AS long, n_nationkey + 25.0 AS lat, n_regionkey AS region FROM nation)"


@query("v4_area_map", f"""
SELECT rb, {r('a', 8)} AS a, CASE WHEN a <= 113 THEN '<= 113.0' WHEN a <= 116 THEN '113.0 - 116.0' ELSE '> 116.0' END AS bin_label, region FROM {REVENUE} JOIN {CENTROIDS} ON id = rb""")
def _(spark, sf):
    spec = {"x": "rb", "y": "a", "y_scale": "1e-6", "chart_type": "Area Map", "map_bin": "Manual", "map_manual": "113, 116"}
    d, _, _ = view.map_view(facts(spark, sf, "rb", "a"), spec)
    regions = table(spark, sf, "nation").select(F.col("n_name").alias("rb"), F.col("n_regionkey").alias("region"))
    return rounded(joins.join_attributes(d, regions, "rb").select("rb", "a", "bin_label", "region"), 8, "a")


@query("v5_line_map_with_arrows", f"""
WITH c AS {CENTROIDS}, g AS (SELECT from_nation, rb, sum(a) * 1e-6 AS a FROM {facts_sql('from_nation', 'rb', 'a')} GROUP BY 1, 2)
SELECT concat('NATION_', from_nation, '-', rb) AS route, {r('g.a', 8)} AS a, CASE WHEN g.a <= 1 THEN '<= 1.0' ELSE '> 1.0' END AS bin_label,
 {r('CAST(f.long + (t.long - f.long) * 0.7 AS DOUBLE)', 4)} AS arrow_x, {r('CAST(f.lat + (t.lat - f.lat) * 0.7 AS DOUBLE)', 4)} AS arrow_y
FROM g JOIN c f ON f.id = concat('NATION_', from_nation) JOIN c t ON t.id = rb""")
def _(spark, sf):
    d = facts(spark, sf, "from_nation", "rb", "a").select(F.concat(F.lit("NATION_"), "from_nation", F.lit("-"), "rb").alias("route"), "a")
    spec = {"x": "route", "y": "a", "y_scale": "1e-6", "chart_type": "Line Map", "map_arrows": "Yes", "map_bin": "Manual", "map_manual": "1"}
    rows, _, _ = view.map_view(d, spec)
    points = table(spark, sf, "nation").select("n_name", (F.col("n_nationkey") * 2.0 - 120).alias("x"), (F.col("n_nationkey") + 25.0).alias("y"))
    ends = F.split("route", "-")
    for side, i in (("from", 0), ("to", 1)):
        p = points.select(F.col("n_name").alias(f"__{side}"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
        rows = rows.join(p, ends[i] == F.col(f"__{side}")).drop(f"__{side}")
    return rounded(rounded(prep.arrow_ends(rows, 0.7).select("route", "a", "bin_label", "arrow_x", "arrow_y"), 8, "a"), 4, "arrow_x", "arrow_y")


@query("s10_full_load", f"""
WITH g AS (SELECT rb, tech, year, sum(b) AS b FROM {facts_sql('rb', 'tech', 'year', 'b')} GROUP BY 1, 2, 3)
SELECT x.rb, CASE t.tech WHEN 'SMALL' THEN 'Small parts' WHEN 'LARGE' THEN 'Large parts' ELSE t.tech END AS tech, y.year, {r('coalesce(g.b, 0)', 2)} AS b, CAST(n_regionkey AS VARCHAR) AS region
FROM (SELECT DISTINCT rb FROM g) x CROSS JOIN (SELECT DISTINCT tech FROM g) t CROSS JOIN (SELECT DISTINCT year FROM g) y LEFT JOIN g ON g.rb = x.rb AND g.tech = t.tech AND g.year = y.year JOIN nation ON n_name = x.rb""")
def _(spark, sf):
    result = agg.densify(facts(spark, sf, "rb", "tech", "year", "b"), ["rb", "tech", "year"], ["b"], fill=None)
    regions = table(spark, sf, "nation").select(F.col("n_name").alias("rb"), F.col("n_regionkey").alias("region"))
    style = spark.createDataFrame([("Small parts", "#1f77b4"), ("Large parts", "#ff7f0e")], "order string, color string")
    meta = {"rb": {"join": regions}, "tech": {"map": {"SMALL": "Small parts", "LARGE": "Large parts"}, "style": style}, "region": {"type": "string"}}
    source = scenarios.load_view_source(result, meta)
    assert source.orders["tech"] == ["Small parts", "Large parts"] and source.roles["y-axis"] == ["year", "b"]
    return rounded(source.df.select("rb", "tech", "year", "b", "region"), 2, "b")
