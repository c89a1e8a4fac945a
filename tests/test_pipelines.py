"""Pipelines against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from longview.plans.demand import devices, hourly, retail
from longview.plans.domain import costs, operation, value
from longview.plans.domain.money import Money

FLAT = Money(dollar_year=2004, pv_year=2020, rate=0.10)  # deflator one
C = costs.COST


@pytest.fixture(scope="module")
def sc(spark):
    return spark.createDataFrame([("inv_a", 2020, 1e9), ("inv_a", 2021, 2e9), ("op", 2020, 5e9), ("odd", 2020, 7e9)], f"cost_cat string, year int, `{C}` double")


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([("inv_a", "Capital"), ("op", "Operation")], "cost_cat string, type string")


def test_annualized_cost(spark, sc, types):
    crf = FLAT.rate * 1.1 ** 2 / (1.1 ** 2 - 1)
    d = costs.annualized_cost(sc, types, 2, 3, FLAT)
    got = {(r.cost_cat, r.year): r[C] for r in d.collect()}
    # Payments start the year after the investment and run two years; operation runs one year past its own.
    want = {2020: 0, 2021: crf, 2022: 3 * crf, 2023: 2 * crf, 2024: 0}
    assert {y: got["inv_a", y] for y in want} == pytest.approx(want)
    assert [got["op", y] for y in range(2020, 2025)] == [5, 5, 0, 0, 0]
    assert not any(k[0] == "odd" for k in got) and len(got) == 10
    disc = {(r.cost_cat, r.year): r[costs.DISCOUNTED] for r in d.collect()}
    assert disc["op", 2021] == pytest.approx(5 / 1.1)
    shifted = costs.annualized_cost(sc, types, 2, 3, FLAT, shift_capital=True)
    assert {r.year: r[C] for r in shifted.filter("cost_cat = 'inv_a'").collect()}[2020] == pytest.approx(crf / 1.1)


def test_present_value_of_payments_equals_investment(spark, types):
    one = spark.createDataFrame([("inv_a", 2020, 1e9)], f"cost_cat string, year int, `{C}` double")
    for shift in (False, True):
        d = costs.annualized_cost(one, types, 20, 30, FLAT, shift_capital=shift)
        assert d.agg(F.sum(costs.DISCOUNTED)).first()[0] == pytest.approx(1.0)


def test_model_recovery_factor_is_interpolated(spark):
    years = spark.range(2018, 2025).select(F.col("id").cast("int").alias("year"))
    crf = spark.createDataFrame([(2020, 0.1), (2022, 0.2)], "year int, crf double")
    d = costs.recovery_factors(years, crf, 20, FLAT)
    assert [round(r.crf, 6) for r in d.orderBy("year").collect()] == [0.1, 0.1, 0.1, 0.15, 0.2, 0.2, 0.2]


def test_remove_existing_and_history(spark, sc, types):
    hist = spark.createDataFrame([(2019, 4.0)], "year int, capex double")
    cat = sc.withColumn("cost_cat", F.when(F.col("cost_cat") == "inv_a", costs.CAPACITY_CATEGORY).otherwise(F.col("cost_cat")))
    ty = types.withColumn("cost_cat", F.when(F.col("cost_cat") == "inv_a", costs.CAPACITY_CATEGORY).otherwise(F.col("cost_cat")))
    crf = 0.1 * 1.1 ** 2 / (1.1 ** 2 - 1)
    with_ = costs.annualized_cost(cat, ty, 2, 3, FLAT, history=hist)
    assert {r.year: r[C] for r in with_.filter(F.col("cost_cat") == costs.CAPACITY_CATEGORY).collect()}[2020] == pytest.approx(4 * crf)
    without = costs.annualized_cost(cat, ty, 2, 3, FLAT, history=hist, remove_existing=True)
    assert {r.year: r[C] for r in without.filter(F.col("cost_cat") == costs.CAPACITY_CATEGORY).collect()}[2020] == 0


def test_requirement_prices(spark, rows):
    key = "type string, subtype string, rb string, timeslice string, year int"
    q = spark.createDataFrame([("load", "x", "p1", "h1", 2020, 10.0), ("oper_res", "x", "p1", "h1", 2020, 2.0)], key + ", q double")
    p = spark.createDataFrame([("load", "x", "p1", "h1", 2020, 3.0)], key + ", p double")
    got = {(r.type, r["$"]) for r in value.requirement_prices(q, p, FLAT).collect()}
    assert got == {("load", 30.0), ("oper_res", 0.0), ("tot", 30.0), ("q_load", 10.0), ("q_oper_res", 2.0)}


def test_competitiveness(spark):
    s = "tech string, vintage string, rb string, year int, con_name string, `Bulk $ Dis` double"
    d = spark.createDataFrame([("w", "v", "p1", 2020, "eq_objfn_inv", -100.0), ("w", "v", "p1", 2020, "MWh", 10.0),
                               ("w", "v", "p1", 2020, "eq_supply_demand_balance", 80.0), ("x", "v", "p1", 2020, "MWh", 1.0)], s)
    prices = spark.createDataFrame([("load", 2020, 50.0), ("res_marg", 2020, 5.0), ("oper_res", 2020, 3.0), ("state_rps", 2020, 2.0), ("q_load", 2020, 6.0)], "type string, year int, `$` double")
    r = value.competitiveness(d, prices).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.LCOE, r.LVOE, r.NVOE, r.BCR, r.P_b) == (10.0, 8.0, -2.0, 0.8, 10.0)
    assert (r.PLCOE, r["value factor"], r["integration cost"], r.SLCOE) == (12.5, 0.8, 2.0, 12.0)


def test_curtailment_rate(spark):
    key = "tech string, vintage string, rb string, year int"
    un = spark.createDataFrame([("w", "v", "p1", 2020, 10.0), ("w", "v", "p2", 2020, 10.0)], key + ", `MWh uncurt` double")
    gen = spark.createDataFrame([("w", "v", "p1", 2020, 8.0)], key + ", MWh double")
    load = spark.createDataFrame([("p1", 2020, 40.0), ("p2", 2020, 10.0)], "rb string, year int, `MWh load` double")
    got = {r.rb: (round(r["Curt Rate"], 6), r["VRE penetration n"], r["VRE penetration nat"]) for r in operation.curtailment(un, gen, load).collect()}
    assert got == {"p1": (0.2, 0.25, 0.4), "p2": (1.0, 1.0, 0.4)}


def test_spur_lines_accumulate(spark):
    tr = spark.createDataFrame([("ac", 2020, 1000.0), ("ac", 2021, 2000.0)], "trtype string, year int, `Amount (GW-mi)` double")
    prm = spark.createDataFrame([("ac", 2021, 500.0)], "trtype string, year int, `Trans cap, PRM (GW-mi)` double")
    new = spark.createDataFrame([("upv_1", "p1", "b1", 2020, 160934.0), ("gas", "p1", "b1", 2020, 9e9)], "i string, r string, rscbin string, year int, MW double")
    dist = spark.createDataFrame([("upv_1", "p1", "b1", 1.0)], "i string, r string, rscbin string, dist_km double")
    got = {(r.trtype, r.year): r["Amount (GW-mi)"] for r in operation.spur_lines(tr, prm, new, dist).collect()}
    assert got["spur", 2020] == pytest.approx(100) and got["spur", 2021] == pytest.approx(100) and got["ac", 2021] == 2.0
    assert operation.spur_lines(tr, prm, new, dist, ignore_spur=True).count() == 2


def test_health_damage_carries_forward(spark):
    h = spark.createDataFrame([("m", "c", "so2", "p1", 2020, 1e3, 2e9, 3.0), ("m", "c", "nox", "p1", 2022, 1e3, 1e9, 1.0)],
                              "model string, cr string, e string, rb string, year int, `Emissions (thousand tonnes)` double, `Health damages (billion $)` double, `Health damages (lives)` double")
    d = operation.health_damage(h, FLAT)
    got = {(r.e, r.year): (r["Health damages (billion $)"], r["Total health damages (billion $)"]) for r in d.collect()}
    assert got["so2", 2021] == (2.0, 2.0) and got["nox", 2021] == (0.0, 2.0) and got["so2", 2022] == (2.0, 3.0)


def test_purchases_equal_a_plain_loop(spark):
    stock = [100.0, 120.0, 90.0, 150.0, 150.0]
    k, s = 2.0, 3.0
    surv = lambda age: 0.0 if math.exp(-(age / s) ** k) < 0.001 else math.exp(-(age / s) ** k)
    want = []
    for i, n in enumerate(stock):
        want.append(n - sum(p * surv(i - v) for v, p in enumerate(want)))
    df = spark.createDataFrame([("a", 2010 + i, n, k, s) for i, n in reversed(list(enumerate(stock)))], "g string, year int, stock double, shape double, scale double")
    got = [r.purchases for r in devices.new_purchases(df, ["g"]).orderBy("year").collect()]
    assert got == pytest.approx(want)


def test_hourly_profile_and_peaks(spark):
    use = spark.createDataFrame([(1, 2020, "heat", 10.0), (1, 2020, "heat", 20.0), (1, 2020, "cool", 5.0)], "div int, year int, use string, value double")
    shapes = spark.createDataFrame([("S", 1, 0.5, 0.2), ("S", 2, 0.5, 0.8)], "state string, hour int, heat double, cool double")
    shares = spark.createDataFrame([(7, "S", 1, 0.6), (8, "S", 1, 0.4)], "ba int, state string, div int, share double")
    p = hourly.hourly_profile(use, hourly.area_shapes(shapes, shares, ["heat", "cool"]))
    got = {(r.ba, r.hour): r.value for r in p.collect()}
    assert got[7, 1] == pytest.approx(0.6 * (30 * .5 + 5 * .2)) and sum(got.values()) == pytest.approx(35)
    tm = spark.createDataFrame([(1, "H3"), (2, "H3")], "hour int, slice string")
    peak = hourly.peak_hours(p, tm, 1)
    assert {(r.ba, r.hour) for r in peak.collect()} == {(7, 2), (8, 2)}
    full = hourly.time_map_by_area(tm, p, peak, [2020], 2020, [2018, 2019])
    assert full.count() == 2 * 3 * 2 and full.filter("slice = 'H17'").count() == 6


def test_shares_count_dc_for_maryland(spark, rows):
    counts = spark.createDataFrame([("001", 10.0), ("002", 30.0)], "cnty string, n double")
    geo = spark.createDataFrame([("001", 1, "DC", 5), ("002", 1, "MD", 5)], "cnty string, ba int, state string, div int")
    assert rows(hourly.division_shares(counts, geo, "n")) == [(1, "MD", 5, 1.0)]


def test_market_of_area(spark, rows):
    o = spark.createDataFrame([("p1", "M1", 2.0), ("p1", "M2", 3.0), ("", "M1", 9.0), ("p2", "", 5.0)], "ba string, market string, area double")
    assert rows(retail.market_of_area(o)) == [("p1", "M2")]


def test_reference_efficiency_without_consumption(spark):
    d = spark.createDataFrame([(1, 2010, "HT", 0.0, 0.0), (1, 2009, "HT", 5.0, 5.0)], "div int, year int, use string, energy double, service double")
    assert [r.ref_eff for r in devices.reference_efficiency(d, ["use"], 2009).collect()] == [1.0]


def test_social_cost_reads_the_facts_once(spark, monkeypatch):
    """All four inputs of the query come from one pass over the joined facts."""
    from tests.conftest import SF
    from workload import q_domain
    from workload.registry import QUERIES

    reads, facts = [], q_domain.facts
    monkeypatch.setattr(q_domain, "facts", lambda *a: reads.append(a[2:]) or facts(*a))
    found = QUERIES["d33_social_cost"](spark, SF)
    assert len(reads) == 1
    assert {r[0] for r in found.select("cost_type").distinct().collect()} == {"System cost", "System cost + health"}
