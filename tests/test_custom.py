"""A user's own group functions."""

import math

import pytest
from pyspark.sql import functions as F

from longview.operators import aggregate, custom
from longview.plans.view import ViewSpec
from workload.q_custom import GeometricMean, Moments, PowersOfTwo


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows of which 19,000 are of one group, in many batches and partitions; null and very long keys."""
    d = spark.range(20_000).repartition(7).select(
        F.when(F.col("id") < 19_000, F.lit(2**60 + 1)).when(F.col("id") % 3 == 0, F.lit(2**60 + 2)).when(F.col("id") % 3 == 1, F.col("id") % 5).alias("g"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 97 + 1.5).alias("y"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield d
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_group(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_a_hot_group_is_merged(hot):
    got = by_group(custom.group_function(hot, ["g"], ["y"], GeometricMean()))
    want = by_group(hot.groupBy("g").agg(F.exp(F.avg(F.log("y")))))
    assert got.keys() == want.keys() and 2**60 + 1 in got and None in got
    assert all(math.isclose(got[k][0], want[k][0]) for k in want)
    # What is shuffled: one state per group and task, not the rows.
    sent = custom.group_function(hot, ["g"], ["y"], GeometricMean())
    assert "MapInArrow" in sent._jdf.queryExecution().toString() and "FlatMapGroups" not in sent._jdf.queryExecution().toString()


def test_states_flushed_early_still_merge(hot, monkeypatch):
    monkeypatch.setattr(custom, "HELD_GROUPS", 2)
    got = by_group(custom.group_function(hot, ["g"], ["y"], Moments()))
    want = by_group(hot.groupBy("g").agg(F.avg("y"), F.stddev_pop("y")))
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, rel_tol=1e-9) for k in want for a, b in zip(got[k], want[k]))


def test_rows_per_group_and_no_keys(spark, hot):
    got = custom.group_function(hot.filter("y IS NOT NULL"), [], ["y"], PowersOfTwo())
    want = hot.filter("y IS NOT NULL").groupBy(F.floor(F.log2("y")).cast("int")).agg(F.count("*"), F.sum("y"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    back = custom.with_group_result(hot, [], ["y"], Moments())
    assert back.columns == ["g", "y", "mean", "deviation"] and back.count() == 20_000
    assert back.select("mean").distinct().count() == 1


def test_empty_and_missing(spark):
    d = spark.createDataFrame([("a", None), ("a", None), ("b", 4.0)], "g string, y double")
    assert by_group(custom.group_function(d, ["g"], ["y"], GeometricMean())) == {"a": (None,), "b": (pytest.approx(4.0),)}
    assert custom.group_function(d.limit(0), ["g"], ["y"], GeometricMean()).collect() == []
    assert custom.with_group_result(d, ["g"], ["y"], GeometricMean()).count() == 3


def test_a_registered_name_works_like_a_built_in_one(spark):
    d = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("b", 3.0)], "g string, y double")
    got = by_group(aggregate.aggregate(d, ["g"], "geometric mean", "y", within_range=True))
    assert got == {"a": (pytest.approx(4.0), 2.0, 8.0), "b": (pytest.approx(3.0), 3.0, 3.0)}
    assert ViewSpec.from_dict({"x": "g", "y": "y", "y_agg": "geometric mean"}).y_agg == "geometric mean"
    with pytest.raises(ValueError):
        custom.register("two", Moments())
    with pytest.raises(ValueError):
        aggregate.aggregate(d, ["g"], "no such thing", "y")
