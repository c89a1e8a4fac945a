"""View specs, validation and reports."""

import datetime

import pytest
from pyspark.sql import functions as F

from longview.operators import project
from longview.plans import report, view
from longview.plans.view import ViewSpec, run_view

DATA = [("s1", "coal", "r1", 2020, 4.0, 2.0), ("s1", "wind", "r1", 2020, 1.0, 1.0), ("s1", "coal", "r2", 2021, 6.0, 3.0),
        ("s2", "coal", "r1", 2020, 5.0, 2.0), ("s2", "wind", "r2", 2021, 7.0, 1.0), ("s2", "sun", "r2", 2021, -1.0, 1.0)]


@pytest.fixture(scope="module")
def d(spark):
    return spark.createDataFrame(DATA, "scenario string, tech string, reg string, year int, a double, b double")


def test_columns_and_sort(d):
    v = run_view(d, {"x": "year", "y": "a", "series": "tech", "explode": "scenario"}, {"tech": ["wind", "coal"]})
    assert v.columns == ["scenario", "tech", "year", "a"]
    assert [tuple(r) for r in v.collect()] == [
        ("s1", "wind", 2020, 1.0), ("s1", "coal", 2020, 4.0), ("s1", "coal", 2021, 6.0),
        ("s2", "wind", 2021, 7.0), ("s2", "coal", 2020, 5.0), ("s2", "sun", 2021, -1.0)]


def test_filters_limit_and_other(d):
    v = run_view(d, {"x": "tech", "y": "a", "series_limit": "1", "filter": {"year": "last"}, "sort_data": "No"}
                 | {"series": "reg"})
    assert {tuple(r) for r in v.select("reg", "tech", "a").collect()} == {("r2", "coal", 6.0), ("r2", "wind", 7.0), ("r2", "sun", -1.0)}


def test_net_level_and_cumulative_sort(d):
    v = run_view(d, {"x": "year", "y": "a", "series": "tech", "chart_type": "Bar", "cum_sort": "Descending"})
    assert v.columns[-1] == "Net Level a"
    assert [r.year for r in v.collect()][0] == 2021
    assert {(r.year, r["Net Level a"]) for r in v.collect()} == {(2020, 10.0), (2021, 12.0)}


def test_within_range_switches_comparisons_off(d):
    v = run_view(d, {"x": "year", "y": "a", "range": "Within Series", "adv_op": "Difference", "adv_col": "year", "adv_col_base": "Consecutive"})
    assert [tuple(r) for r in v.collect()] == [(2020, 10.0, 1.0, 5.0), (2021, 12.0, -1.0, 7.0)]


def test_numeric_base_and_scales(d):
    v = run_view(d, {"x": "year", "y": "a", "adv_op": "Difference", "adv_col": "year", "adv_col_base": "2020", "y_scale": "10", "x_scale": "2"})
    assert [tuple(r) for r in v.collect()] == [(4042.0, 20.0)]


def test_no_aggregation_keeps_rows(d):
    v = run_view(d, {"x": "year", "y": "a", "y_agg": "None", "series": "tech"})
    assert v.count() == len(DATA) and set(v.columns) == set(d.columns)


def test_line_map_flips_and_map_bins(spark):
    d = spark.createDataFrame([("p1-p2", -3.0), ("p2-p3", 4.0), ("p3-p1", 0.0)], "`r-r` string, mw double")
    rows, breaks, labels = view.map_view(d, {"x": "r-r", "y": "mw", "chart_type": "Line Map", "map_arrows": "Yes", "map_bin": "Manual", "map_manual": "3.5"})
    assert {(r["r-r"], r.mw, r.bin_label) for r in rows.collect()} == {("p2-p1", 3.0, "<= 3.5"), ("p2-p3", 4.0, "> 3.5")}
    assert breaks == [3.5] and labels == ["<= 3.5", "> 3.5"]


def test_chart_data(d):
    box = view.chart_view(d, {"x": "year", "y": "a", "y_agg": None, "range": "Boxplot"})
    assert {r.year: r.q50 for r in box.collect()} == {2020: 4.0, 2021: 6.0}
    stack = view.chart_view(d, {"x": "year", "y": "a", "series": "tech", "chart_type": "Area"})
    assert {(r.tech, r.base_pos, r.top_pos) for r in stack.collect() if r.year == 2020} == {("coal", 0.0, 9.0), ("sun", 9.0, 9.0), ("wind", 9.0, 10.0)}
    between = view.chart_view(d, {"x": "year", "y": "a", "series": "tech", "chart_type": "Line", "range": "Between Series"})
    assert {tuple(r) for r in between.collect()} == {(2020, 1.0, 9.0), (2021, -1.0, 7.0)}


def test_only_view_columns_are_read(spark, capsys):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    run_view(li, {"x": "l_linenumber", "y": "l_quantity", "filter": {"l_returnflag": ["A"]}}).explain()
    plan = capsys.readouterr().out
    schema = plan[plan.index("ReadSchema"):].splitlines()[0]
    assert "l_quantity" in schema and "l_linenumber" in schema and "l_extendedprice" not in schema
    assert "EqualTo(l_returnflag,A)" in plan and "Python" not in plan


def test_validation(d):
    roles = project.column_roles(d)
    good = ViewSpec(x="year", y="a", series="tech")
    assert view.validate(good, roles) == []
    bad = ViewSpec(x="tech", series="tech", adv_op="Difference", adv_col="scenario", adv_col_base="s9")
    text = " ".join(view.validate(bad, roles, {"scenario": ["s1", "s2"]}))
    assert "y is required" in text and "fills both" in text and "s9 is not a value" in text
    with pytest.raises(ValueError):
        run_view(d, {"x": "year"})


def test_spec_round_trip():
    s = ViewSpec(x="year", y="a", filter={"year": {"start": 1, "exclude": [2]}})
    assert ViewSpec.from_json(s.to_json()) == s
    assert s.non_defaults() == {"x": "year", "y": "a", "filter": {"year": {"start": 1, "exclude": [2]}}}


def test_report_expansion():
    secs = [{"name": "A", "sheet_name": "a"}, {"name": "B", "modify": "keep"}]
    assert [s["name"] for s in report.expand_report(secs, "Yes", "s1")] == ["A", "A - difference from s1", "B"]
    both = report.expand_report(secs, "Base + Diff", "s1")
    assert [(s["name"], s.get("sheet_name"), s.get("modify")) for s in both] == [
        ("A - base", "a_base", "base_only"), ("A - difference from s1", "a_diff", "diff"), ("B", None, "keep")]
    assert [s["name"] for s in report.expand_report(secs, "Diff Only", "s1")] == ["A - difference from s1", "B"]
    assert secs == [{"name": "A", "sheet_name": "a"}, {"name": "B", "modify": "keep"}]


def test_report_isolates_failures(spark, d, tmp_path):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9)
    secs = [{"name": "ok/1", "config": {"x": "year", "y": "a"}}, {"name": "bad", "config": {"x": "nope", "y": "a"}},
            {"name": "base", "modify": "base_only", "config": {"x": "tech", "y": "a"}}]
    done = report.run_report(spark, d, secs, str(tmp_path), base="s1", now=when, sources=["mem"])
    assert [x.error is None for x in done] == [True, False, True]
    assert done[0].path.endswith("report-2024-05-06-07-08-09/1_ok-1.csv")
    assert {r.tech for r in spark.read.csv(done[2].path, header=True).collect()} == {"coal", "wind"}
    meta = {tuple(r) for r in spark.read.csv(f"{tmp_path}/report-2024-05-06-07-08-09/meta.csv", header=True).collect()}
    assert ("Data Source", "mem") in meta
    with pytest.raises(Exception, match="already exists"):
        report.run_report(spark, d, secs[:1], str(tmp_path), now=when)
