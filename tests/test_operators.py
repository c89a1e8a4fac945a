"""Small hand-computed cases and algebraic properties of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate as agg
from longview.operators import joins, ordered, prep, project, ranking, reshape, windows
from longview.operators.compare import compare, compare_chain

DATA = [("s1", "a", 2020, 1.0), ("s1", "b", 2020, 3.0), ("s2", "a", 2020, 2.0), ("s1", "a", 2021, 5.0), ("s2", "a", 2021, 0.0)]


@pytest.fixture(scope="module")
def d(spark):
    return spark.createDataFrame(DATA, "scenario string, tech string, year int, y double")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.finite(F.lit(float("inf")))) is None
    assert one(spark, S.finite(F.lit(float("nan")))) is None
    assert S.capital_recovery_factor(0.05, 20) == pytest.approx(0.0802425872)
    assert one(spark, S.survival(F.lit(100), F.lit(2.0), F.lit(10))) == 0.0
    assert one(spark, S.survival(F.lit(10), F.lit(2.0), F.lit(10))) == pytest.approx(math.exp(-1))
    assert one(spark, S.class_of(F.lit("wind-ons_3"))) == "class_3"
    assert one(spark, S.class_of(F.lit("coal"))) is None
    assert one(spark, S.zero_pad(F.lit(1234567), 6)) == "1234567"
    assert one(spark, S.part(F.lit("a.b"), ".", 1)) == "b"
    assert one(spark, S.join_text("-", F.lit("a"), F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("x,text", [(0.0, "0.00E+00"), (0.5, "0.5"), (1234.0, "1230"), (99999.0, "100000"), (123456.0, "1.23E+05"), (22450000.0, "2.24E+07"), (-12.345, "-12.3"), (0.0004, "4.00E-04")])
def test_short_number(spark, x, text):
    assert one(spark, S.short_number(F.lit(x))) == text
    if x:
        assert S.short_number_text(x) == text


def test_compare_fixed_base(d, rows):
    assert rows(compare(d, "Difference", "scenario", "s1", "y")) == [("s2", "a", 2020, 1.0), ("s2", "a", 2021, -5.0)]
    assert rows(compare(d, "Ratio", "scenario", "s1", "y")) == [("s2", "a", 2020, 2.0), ("s2", "a", 2021, 0.0)]
    # Without a base row the reference is 0: differences stay, ratios become 0.
    assert rows(compare(d.filter("tech = 'a'"), "Ratio", "scenario", "none", "y"))[0][3] == 0.0
    assert rows(compare(d, "Difference", "tech", "a", "y")) == [("s1", "b", 2020, 2.0)]


def test_compare_consecutive_and_total(d, rows):
    assert rows(compare(d, "Difference", "year", "Consecutive", "y")) == [("s1", "a", 2021, 4.0), ("s2", "a", 2021, -2.0)]
    assert rows(compare(d, "Ratio", "scenario", "Consecutive", "y")) == [("s2", "a", 2020, 2.0), ("s2", "a", 2021, 0.0)]
    total = compare(d, "Ratio", "tech", "Total", "y")
    # A group whose sum is zero has no shares; the others add up to one.
    assert all(abs(r.s - 1) < 1e-9 for r in total.groupBy("scenario", "year").agg(F.sum("y").alias("s")).collect())
    diff = compare(d, "Difference", "tech", "Total", "y")
    assert ("s1", "b", 2020, -1.0) in rows(diff)


def test_compare_without_other_columns(d, rows):
    one = d.groupBy("tech").agg(F.sum("y").alias("y"))
    assert rows(compare(one, "Ratio", "tech", "Total", "y")) == [("a", 8 / 11), ("b", 3 / 11)]
    assert rows(compare(one, "Difference", "tech", "Consecutive", "y")) == [("b", -5.0)]
    year = d.groupBy("year").agg(F.sum("y").alias("y"))
    assert rows(compare(year, "Difference", "year", "Consecutive", "y")) == [(2021, -1.0)]


def test_compare_keeps_null_groups(spark, rows):
    n = spark.createDataFrame([(None, "x", 1.0), (None, "b", 4.0)], "g string, c string, y double")
    assert rows(compare(n, "Difference", "c", "b", "y")) == [(None, "x", -3.0)]


def test_chain(d, rows):
    out = compare_chain(d, [("Difference", "scenario", "s1"), ("Difference", "year", "Consecutive")], "y")
    assert rows(out) == [("s2", "a", 2021, -6.0)]


def test_densify_fills_every_combination(d):
    full = agg.densify(d, ["scenario", "tech", "year"], ["y"])
    assert full.count() == 2 * 2 * 2
    assert full.filter("y = 0").count() == 4
    assert full.agg(F.sum("y")).first()[0] == 11.0


def test_densify_beyond_the_domain_bound(d, monkeypatch):
    monkeypatch.setattr(agg, "MAX_DOMAIN", 1)
    assert agg.densify(d, ["scenario", "tech", "year"], ["y"]).count() == 8


def test_complete_categories_of_many_categories_and_null_keys(spark, d, rows, monkeypatch):
    assert agg.complete_categories(d, ["scenario", "year"], "tech", "y").count() == 8
    few = spark.createDataFrame([("k", "a", 1.0), (None, "a", 2.0), (None, "b", 4.0), (None, "b", 6.0), ("k", None, 9.0)], "k string, c string, v double")
    want = [("k", "a", 1.0), ("k", "b", 0.0), (None, "a", 2.0), (None, "b", 5.0)]
    assert sorted(rows(agg.complete_categories(few, ["k"], "c", "v")), key=str) == sorted(want, key=str)
    monkeypatch.setattr("longview.operators.joins.MAX_INLINE_ROWS", 1)
    assert sorted(rows(agg.complete_categories(few, ["k"], "c", "v")), key=str) == sorted(want, key=str)


def test_order_of_more_than_9999_listed_values(spark):
    order = [f"v{i}" for i in range(10050)]
    df = spark.createDataFrame([(v,) for v in ("v10000", "v9999", "v999", "v9", "w")], "s string")
    got = [r.s for r in prep.series_colors(df, "s", order).orderBy("color_index").collect()]
    assert got == ["v9", "v999", "v9999", "v10000", "w"]


def test_transpose_of_more_rows_than_columns_allow(spark):
    df = spark.createDataFrame([(f"k{i:04d}", float(i), -float(i)) for i in range(700)], "k string, a double, b double")
    got = {r.key: r for r in reshape.transpose(df, "k").collect()}
    assert len(got["a"]) == 701 and got["a"].k0699 == 699.0 and got["b"].k0003 == -3.0


def test_histogram_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.exponential(10, 400), np.linspace(0, 50, 11), [0.0, 50.0]])
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    for weighted in (False, True):
        want, edges = np.histogram(y, bins=10, weights=y if weighted else None)
        got = sorted(agg.histogram(df, "y", 10, weighted=weighted).collect())
        assert np.allclose([r[1] for r in got], want)
        assert np.allclose([r[0] for r in got], (edges[1:] + edges[:-1]) / 2)


def test_histogram_of_one_value(spark, rows):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 3.0)], "g string, y double")
    got = rows(agg.histogram(df, "y", 4, ["g"]))
    assert [r[1] for r in got if r[0] == "a"] == [2.625, 2.875, 3.125, 3.375]
    assert sum(r[2] for r in got) == 3 and len(got) == 8


def test_aggregations_null_on_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 2.0)], "g string, a double, b double, c double")
    for how in ("sum(a)/sum(b)", "sum(a*b)/sum(b)", "[sum(a*b)/sum(b)]/[sum(a*c)/sum(c)]"):
        assert agg.aggregate(df, ["g"], how, "a", "b", "c").first().a is None
    with pytest.raises(ValueError):
        agg.aggregation("median(a)", "a")


def test_argmax_keeps_ties(spark, rows):
    df = spark.createDataFrame([("p1", "x", 5.0), ("p1", "y", 5.0), ("p1", "z", 1.0), ("p2", "x", 2.0)], "ba string, m string, area double")
    assert rows(agg.argmax_rows(df, ["ba"], "area"), "ba", "m") == [("p1", "x"), ("p1", "y"), ("p2", "x")]


def test_pivot_round_trip_and_strictness(d, rows):
    wide = reshape.pivot_first(d, ["scenario", "tech"], "year", "y")
    back = reshape.melt(wide, ["scenario", "tech"], None, "year", "y").filter("y IS NOT NULL")
    assert rows(back.select("scenario", "tech", F.col("year").cast("int"), "y")) == sorted(DATA, key=str)
    with pytest.raises(Exception, match="duplicate entries"):
        reshape.pivot_strict(d, ["scenario"], "year", "y").collect()


def test_melt_keeps_names_with_dots(spark, rows):
    df = spark.createDataFrame([(1, 2.0)], "`k.k` int, `a.b` double")
    assert rows(reshape.melt(df, ["k.k"], None, "n", "v")) == [(1, "a.b", 2.0)]


def test_lookup_rules(spark, rows):
    df = spark.createDataFrame([("t1",), ("t2",), ("t9",)], "tech string")
    look = spark.createDataFrame([("x", "t1", "B", 2), ("y", "t1", "A", 9), ("z", "t2", "C", 1)], "left string, tech string, kind string, n int")
    assert rows(joins.join_attributes(df, look, "tech")) == [("t1", "A", 9), ("t2", "C", 1)]
    m = spark.createDataFrame([("t1", "old", 1), ("t1", "new", 2)], "raw string, display string, i int")
    assert rows(joins.map_values(df, "tech", m, "i")) == [("new",), ("t2",), ("t9",)]
    assert rows(joins.map_values(df, "tech", {"t2": "two"})) == [("t1",), ("t9",), ("two",)]
    assert rows(joins.unmapped(df, "tech", look)) == [("t9",)]


def test_product_with_a_table_beyond_the_inline_bound(spark, monkeypatch):
    a, b = spark.range(3).toDF("a"), spark.range(4).toDF("b")
    assert joins.expand_by(a, b).count() == 12
    monkeypatch.setattr(joins, "MAX_INLINE_ROWS", 2)
    assert joins.expand_by(a, b).count() == 12
    assert joins.expand_by(a, b.limit(0)).count() == 0


def test_year_expansion(spark, rows):
    df = spark.createDataFrame([("a", 2008, 2011), ("b", 2019, 2030), ("c", 2030, 2040)], "o string, f int, l int")
    got = rows(joins.within_years(df, "f", "l", 2010, 2020), "o", "year")
    assert got == [("a", 2010), ("a", 2011), ("b", 2019), ("b", 2020)]


def test_top_n_breaks_ties_by_name(spark, rows):
    df = spark.createDataFrame([("a", -5.0), ("b", 5.0), ("c", 5.0), ("d", 1.0)], "s string, y double")
    assert rows(ranking.top_n_series(df, "s", "y", 2)) == [("Other", 1.0), ("Other", 5.0), ("a", -5.0), ("b", 5.0)]


def test_order_and_strip(spark):
    df = spark.createDataFrame([("007",), ("12",), ("3",)], "h string")
    assert [r.h for r in ranking.sort_rows(df, ["h"]).collect()] == ["7", "12", "3"]
    assert [r.h for r in ranking.sort_rows(df, ["h"], {"h": ["3", "12"]}).collect()] == ["3", "12", "007"]


def test_breakpoints_and_labels(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 5, 8, 13, 21]], "y double")
    values = sorted({1, 2, 3, 5, 8, 13, 21})
    want = [float(values[int((i + 1) * (len(values) - 1) / 4)]) for i in range(3)]
    assert ranking.breakpoints(df, "y", "equal number", 4) == want
    assert ranking.breakpoints(df, "y", "equal width", 4) == [6.0, 11.0, 16.0]
    assert ranking.breakpoints(df, "y", "equal width", 5, lo=0, hi=30) == [0, 10, 20, 30]
    assert ranking.breakpoints(df, "y", "manual", manual="-1, 2.5") == [-1.0, 2.5]
    assert ranking.bin_labels([0.5, 1234.0]) == ["<= 0.5", "0.5 - 1230", "> 1230"]
    got = ranking.label_bins(ranking.assign_bins(df, "y", [2.0, 8.0]), "bin_index", [2.0, 8.0])
    assert [r[1] for r in rows(got.orderBy("y").select("y", "bin_index"))].count(0) == 3


def test_stack_levels(spark, rows):
    df = spark.createDataFrame([("x", "a", 2.0), ("x", "b", -1.0), ("x", "c", 3.0), ("x", "d", -4.0)], "x string, s string, y double")
    got = {r.s: (r.base_pos, r.top_pos, r.base_neg, r.top_neg) for r in prep.stack_levels(df, "x", "y", "s").collect()}
    assert got == {"a": (0, 2, 0, 0), "b": (2, 2, 0, -1), "c": (2, 5, -1, -1), "d": (5, 5, -1, -5)}
    assert rows(prep.net_line(df, "x", "y")) == [("x", 0.0)]
    more = df.union(spark.createDataFrame([("z", "b", 5.0)], df.schema))
    at_z = {r.s: (r.y, r.base_pos, r.top_pos) for r in prep.stack_levels(more, "x", "y", "s").filter("x = 'z'").collect()}
    assert at_z == {"a": (0, 0, 0), "b": (5, 0, 5), "c": (0, 5, 5), "d": (0, 5, 5)}
    bounds = prep.axis_bounds(df.withColumn("y", F.abs("y")), None, "y", "s", stacked=True).first()
    assert (bounds.y_min, bounds.y_max) == (0.0, 10.0)


def test_update_where_is_sequential(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, v double")
    cases = [(F.col("k") == "a", F.lit(5.0)), (F.col("v") > 0, F.col("v") + 1)]
    assert rows(project.update_where(df, "v", cases)) == [("a", 2.0), ("b", 2.0)]


def test_roles_and_fill(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.5), (None, None, None)], "t string, n int, v double")
    roles = project.column_roles(df)
    assert roles["filterable"] == ["t", "n"] and roles["y-axis"] == ["n", "v"]
    assert rows(project.fill_by_role(df)) == [("a", 1, 1.5), ("{BLANK}", 0, 0.0)]
    many = spark.range(600).selectExpr("id", "id % 499 as few", "id % 500 as edge")
    assert project.few_valued_columns(many, ["id", "few", "edge"], 500) == ["few"]


def test_sentinels_convert_all_or_nothing(spark):
    df = spark.createDataFrame([("Eps", "1", "x"), ("2.5", "two", "Undf")], "a string, b string, c string")
    out = project.clean_sentinels(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [r.a for r in out.collect()] == [0.0, 2.5] and out.collect()[1].c == "0"


def test_share_sums_to_one(d):
    for raw in (False, True):
        s = windows.share(d, "y", ["scenario"], raw=raw)
        assert all(abs(r.t - 1) < 1e-12 for r in s.groupBy("scenario").agg(F.sum("share").alias("t")).collect())


@pytest.mark.parametrize("how", agg.AGGREGATIONS)
def test_top_series_in_one_pass_equal_two(spark, how, capsys):
    rnd = random.Random(3)
    rows_ = [(rnd.choice(["a", "b", "c", "d", None]), rnd.randint(1, 4), rnd.uniform(-5, 5), rnd.uniform(0, 3), rnd.uniform(1, 2)) for _ in range(400)]
    rows_ += [("e", 1, 0.0, 0.0, 0.0), ("tie1", 1, 1.0, 1.0, 1.0), ("tie2", 1, 1.0, 1.0, 1.0), ("f", 2, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows_, "s string, x int, y double, v double, w double").repartition(3)
    for n in (0, 2, 5, 100):
        two = agg.aggregate(ranking.top_n_series(d, "s", "y", n), ["s", "x"], how, "y", "v", "w", True)
        one = agg.aggregate_top(d, ["s", "x"], how, "y", "v", "w", True, "s", n)
        flat = lambda df: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) if c == "s" else c for c in two.columns]).collect())
        assert flat(one) == flat(two)


def test_top_series_read_the_facts_once(spark, tmp_path):
    spark.range(3000).select((F.col("id") % 9).cast("string").alias("s"), (F.col("id") % 5).alias("x"), F.col("id").cast("double").alias("y")).write.parquet(str(tmp_path / "t"))
    d = agg.aggregate_top(spark.read.parquet(str(tmp_path / "t")), ["s", "x"], "sum(a)", "y", series="s", n=3)
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("ReadSchema") == 1


def test_outline_chunks_draw_the_whole_line(spark):
    points = spark.range(1000).select(F.when(F.col("id") < 900, "big").when(F.col("id") < 964, "even").otherwise("small").alias("group"), F.col("id"),
                                      (F.col("id") * 7919 % 1000).alias("seq"), F.col("id").alias("x"), (-F.col("id")).alias("y"))
    whole = {r.group: [tuple(p) for p in r.outline] for r in prep.polygons(points).collect()}
    for slices in (ordered.Slices(), ordered.plan_slices(points, "seq", ["group"], least=7)):
        got = {}
        for r in prep.outline_chunks(points, size=32, slices=slices).orderBy("group", "chunk").collect():
            assert len(r.outline) <= 33
            line = got.setdefault(r.group, [])
            assert r.chunk == 0 or tuple(r.outline[0]) == line[-1]
            line += [tuple(p) for p in r.outline][1 if r.chunk else 0:]
        assert got == whole


def test_products_of_any_size(spark):
    a = spark.range(5).select(F.col("id").alias("a"))
    b = spark.range(3000).select((F.col("id") % 1500).alias("b"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise("x").alias("c"))
    got = joins.expand_by(a, b)
    assert got.count() == 15_000 and got.filter("c IS NULL").count() == 5 * b.filter("c IS NULL").count()
    assert got.groupBy("a", "b", "c").count().exceptAll(a.crossJoin(b).groupBy("a", "b", "c").count()).count() == 0
    assert joins.expand_by(a.limit(0), b).count() == 0
