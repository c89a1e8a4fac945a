"""Sliced ordered operators equal the plain windows, whatever the slices."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from longview.operators import ordered, prep, ranking, windows
from longview.operators.ordered import Slices
from tests.conftest import SF


@pytest.fixture(scope="module")
def ev(spark):
    d = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "ts", "value")
    # One hot group with two thirds of the rows, ties in the order column, gaps in the value.
    return (d.withColumn("g", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("hot"))
             .withColumn("g", F.expr("nullif(g, 'view')"))
             .withColumn("h", F.hour("ts"))
             .withColumn("v", F.when(F.col("event_id") % 4 == 0, F.col("value"))))


def differences(df):
    same = F.col("out").eqNullSafe(F.col("want")) | (F.abs(F.col("out") - F.col("want")) < 1e-6)
    return df.filter(~F.coalesce(same, F.lit(False))).count()


@pytest.mark.parametrize("rows_per_slice", [60, 10**9])
def test_operators(ev, rows_per_slice):
    s = ordered.plan_slices(ev, "ts", ["g"], rows_per_slice)
    assert bool(s.bounds) == (rows_per_slice == 60)
    by, order = ["g"], ["ts", "event_id"]
    W = Window.partitionBy("g").orderBy("ts", "event_id")
    UP = W.rowsBetween(Window.unboundedPreceding, 0)
    assert differences(ordered.running_sum(ev, "value", by, order, "out", s).withColumn("want", F.sum("value").over(UP))) == 0
    assert differences(ordered.running_sum(ev, "v", by, order, "out", s).withColumn("want", F.sum("v").over(UP))) == 0
    assert differences(ordered.previous_value(ev, "v", by, order, "out", s).withColumn("want", F.lag("v").over(W))) == 0
    assert differences(ordered.fill_forward(ev, "v", by, order, "out", s).withColumn("want", F.last("v", True).over(UP))) == 0
    assert differences(ordered.number_rows(ev, by, order, "out", s).withColumn("want", F.row_number().over(W))) == 0
    down = W.rowsBetween(0, Window.unboundedFollowing)
    assert differences(ordered.fill_backward(ev, "v", by, order, "out", s).withColumn("want", F.first("v", True).over(down))) == 0
    plain = ordered.interpolate(ev, "v", by, order, "want", Slices()).select("event_id", "want")
    assert differences(ordered.interpolate(ev, "v", by, order, "out", s).join(plain, "event_id")) == 0
    for n in (1, 2, 5, 90):  # 90 rows are more than a slice holds
        last = W.rowsBetween(-(n - 1), 0)
        want = F.when(F.count("value").over(last) == n, F.sum("value").over(last))
        assert differences(ordered.rolling_sum(ev, "value", by, order, n, "out", s).withColumn("want", want)) == 0
        assert differences(ordered.fill_limited(ev, "v", by, order, n - 1, "out", s).withColumn("want", F.last("v", True).over(last))) == 0


@pytest.mark.parametrize("by, least", [(["g"], 6), ([], 1)])
def test_no_frame_is_worked_out_anew_for_each_row(spark, by, least):
    """A frame from each row to the end of its group takes the square of the rows."""
    rows = [(i % 2, None if i % 9 == 0 else i // 3, i, None if i % 5 else float(i % 11)) for i in range(240)]
    d = spark.createDataFrame(rows, "g int, t int, i int, y double")
    s = ordered.plan_slices(d, "t", by, least=least)
    assert bool(s.bounds) == (least > 1)
    W = Window.partitionBy(*by or [F.lit(0)]).orderBy("t", "i")
    want = F.first("y", True).over(W.rowsBetween(0, Window.unboundedFollowing))
    filled = ordered.fill_backward(d, "y", by, ["t", "i"], "out", s)
    assert filled.columns == [*d.columns, "out"]
    assert filled.count() == 240 and differences(filled.withColumn("want", want)) == 0
    inside = ordered.fill_backward(d.withColumn("same", F.col("y")), "same", by, ["t", "i"], "same", s)
    assert differences(inside.withColumnRenamed("same", "out").withColumn("want", want)) == 0
    for found in (filled, ordered.interpolate(d, "y", by, ["t", "i"], "out", s)):
        plan = found._jdf.queryExecution().analyzed().toString().lower()
        assert "windowframe" in plan and "currentrow$(), unboundedfollowing" not in plan


def test_halo_with_ties_nulls_and_no_keys(spark):
    rows = [(None if i % 7 == 0 else i // 3, i, None if i % 4 == 1 else float(i % 11)) for i in range(200)]
    d = spark.createDataFrame(rows, "t int, i int, y double")
    s = ordered.plan_slices(d, "t", [], least=9)
    assert len(s.bounds) > 4
    W = Window.partitionBy(F.lit(0)).orderBy("t", "i")
    for n in (3, 40):
        last = W.rowsBetween(-(n - 1), 0)
        got = ordered.fill_limited(d, "y", [], ["t", "i"], n - 1, "out", s)
        assert got.columns == ["t", "i", "y", "out"] and got.count() == 200
        assert differences(got.withColumn("want", F.last("y", True).over(last))) == 0
        got = ordered.rolling_sum(d, "y", [], ["t", "i"], n, "y", s).withColumnRenamed("y", "out")
        whole = d.withColumn("want", F.when(F.count("y").over(last) == n, F.sum("y").over(last))).select("i", "want")
        assert differences(got.join(whole, "i")) == 0
    assert ordered.rolling_sum(d.limit(0), "y", [], ["t", "i"], 3, "out", s).count() == 0


def test_windows_over_rows_are_dealt_by_slice(ev, capsys):
    s = ordered.plan_slices(ev, "ts", ["g"], least=8)
    order = ["ts", "event_id"]
    for f in (lambda: ordered.rolling_sum(ev, "value", ["g"], order, 3, "out", s), lambda: ordered.fill_limited(ev, "value", ["g"], order, 3, "out", s),
              lambda: ordered.fill_backward(ev, "v", ["g"], order, "out", s), lambda: ordered.interpolate(ev, "v", ["g"], order, "out", s)):
        f().explain()
        windows_in_plan = [line for line in capsys.readouterr().out.splitlines() if "- Window [" in line]
        # What runs over a whole group reads one row per slice: it is ordered by the slice or its end, never by the rows.
        rows = [line for line in windows_in_plan if "event_id#" in line.split("windowspecdefinition", 1)[1]]
        assert rows and all("__slice#" in line for line in rows)


def test_slices_by_text_follow_text_order(spark):
    d = spark.createDataFrame([(c,) for c in ["", "a", "aa", "ab", "b", "ä", "z", "Z", "1", "10", "2"]], "t string")
    cut = ordered.Slices(("1", "a", "b", "z")).assign(d, "t").orderBy("t").collect()
    assert [r[ordered.SLICE] for r in cut] == sorted(r[ordered.SLICE] for r in cut) and len({r[ordered.SLICE] for r in cut}) == 5


def test_text_slices_with_a_long_common_prefix(spark):
    d = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("t"))
    s = ordered.plan_slices(d, "t", [], 400)
    sizes = [r["count"] for r in s.assign(d, "t").groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 800
    got = ordered.number_rows(d, [], ["t"], "n", s).agg(F.max(F.abs(F.col("n") - 1 - F.substring("t", 10, 9).cast("int")))).first()[0]
    assert got == 0


def test_wall_clock_order_ignores_the_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        d = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-03-10 00:30:00', timestamp_ntz'2024-03-10 05:00:00', interval 15 minutes)) AS t")
        p = [r.p for r in d.select("t", ordered.position(d, "t").alias("p")).orderBy("t").collect()]
        assert p == sorted(set(p)) and p[1] - p[0] == 900
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_quantiles_equal_exact_percentile(ev):
    probs = prep.BOX_PROBS
    want = {r.g: r.p for r in ev.groupBy("g").agg(F.percentile("value", F.array(*[F.lit(p) for p in probs.values()])).alias("p")).collect()}
    for s in (Slices(), ordered.plan_slices(ev, "value", ["g"], 40)):
        got = ordered.quantiles(ev, "value", ["g"], probs, s).collect()
        assert len(got) == len(want)
        for r in got:
            assert [round(r[n], 9) for n in probs] == [round(x, 9) for x in want[r.g]]


def test_quantiles_with_ties_and_single_rows(spark):
    d = spark.createDataFrame([("a", 5.0)] * 7 + [("a", 9.0), ("b", 1.0)], "g string, y double")
    got = {r.g: (r.q50, r.q95) for r in ordered.quantiles(d, "y", ["g"], {"q50": .5, "q95": .95}, Slices((4.0, 6.0), 2)).collect()}
    assert got["b"] == (1.0, 1.0) and got["a"][0] == 5.0 and abs(got["a"][1] - 7.6) < 1e-9


def test_top_rows_are_limited_before_the_shuffle(ev, capsys):
    ranking.top_rows(ev, ["g"], [F.col("value").desc()], 3).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2


def test_limited_fill_and_interpolation(spark):
    d = spark.createDataFrame([("a", y, v) for y, v in [(1, None), (2, 10.0), (3, None), (4, None), (5, 40.0), (6, None)]], "g string, year int, y double")
    get = lambda x: [r.y for r in x.orderBy("year").collect()]
    assert get(windows.ffill(d, "y", ["g"], ["year"], 1)) == [None, 10, 10, None, 40, 40]
    assert get(windows.bfill(d, "y", ["g"], ["year"])) == [10, 10, 40, 40, 40, None]
    assert get(windows.interpolate(d, "y", ["g"], "year")) == [None, 10, 20, 30, 40, 40]
    assert get(windows.rolling_sum(windows.ffill(d, "y", ["g"], ["year"]), "y", ["g"], ["year"], 3)) == [None, None, None, 30, 60, 90]
