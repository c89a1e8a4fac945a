"""Energy-system pipelines (D) on result tables derived from the line facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.plans.domain import costs, operation, regions, value
from longview.plans.domain.money import Money
from workload.facts import facts, facts_sql, materialise, table
from workload.registry import query, r, rounded

DEFL = 0.697349107
COST_CATS = {"ECONOMY": "inv_investment_capacity_costs", "LARGE": "inv_transmission_line_investment",
             "MEDIUM": "inv_other", "PROMO": "op_fuel", "SMALL": "op_fixed", "STANDARD": "op_unmapped"}
REQUIREMENTS = {"ECONOMY": "load", "LARGE": "res_marg", "MEDIUM": "oper_res", "PROMO": "state_rps", "SMALL": "nat_gen", "STANDARD": "other"}
CONS = ["eq_objfn_inv", "eq_objfn_op", "eq_supply_demand_balance", "eq_reserve_margin", "eq_opres_requirement", "eq_rec_requirement",
        "eq_gasused", "eq_cap_new_noret", "eq_cap_upgrade", "eq_curtailment", "eq_storage_in_max", "eq_other"]
VARS = {"A": "inv", "N": "gen", "R": "cap"}


def case(column: str, table_: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SEASON = "concat('q', CAST(floor((month - 1) / 3) AS INTEGER) + 1)"
CON = "CASE month " + " ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(CONS)) + " END"
BRAND_NO = "CAST(substring(p_brand, 7) AS INTEGER)"
LINE = ("scenario", "tech", "status", "flag", "rb", "segment", "brand", "year", "month", "a", "b", "c")

# Derived input tables as SQL; the same texts build the Spark tables from the shared facts.
T = {
    "sc": f"SELECT {case('tech', COST_CATS)} AS cost_cat, segment AS r, year, sum(a) * 1e4 AS cost FROM f WHERE year NOT IN (1996, 1999) GROUP BY 1, 2, 3",
    "types": f"SELECT DISTINCT {case('tech', COST_CATS)} AS cost_cat, CASE WHEN tech IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'Capital' ELSE 'Operation' END AS type FROM f WHERE tech <> 'STANDARD'",
    "crf": "SELECT DISTINCT year, 0.08 + (year - 1995) * 0.002 AS crf FROM f WHERE year IN (1996, 1999)",
    "pvf_cap": "SELECT DISTINCT year, 1 - 0.02 * (year - 1995) AS pvfcap FROM f",
    "pvf_onm": "SELECT DISTINCT year, 0.9 + 0.01 * (year - 1995) AS pvfonm FROM f",
    "q": f"SELECT {case('tech', REQUIREMENTS)} AS type, status AS subtype, segment AS rb, concat('h', month % 4 + 1) AS timeslice, year, sum(b) AS q FROM f GROUP BY 1, 2, 3, 4, 5",
    "p": f"SELECT {case('tech', REQUIREMENTS)} AS type, status AS subtype, segment AS rb, concat('h', month % 4 + 1) AS timeslice, year, sum(a) / sum(b) / 1000 AS p FROM f WHERE NOT (status = 'O' AND month = 3) AND flag <> 'R' AND segment <> 'MACHINERY' GROUP BY 1, 2, 3, 4, 5",
    "vs": f"SELECT tech, status AS vintage, segment AS rb, year, {case('flag', VARS)} AS var_name, {CON} AS con_name, sum(CASE WHEN month IN (1, 2, 7) THEN -a ELSE a END) AS usd FROM f GROUP BY 1, 2, 3, 4, 5, 6",
    "gen": "SELECT tech, status AS vintage, segment AS rb, year, sum(b) AS mwh FROM f GROUP BY 1, 2, 3, 4",
    "uncurt": "SELECT tech, status AS vintage, segment AS rb, year, sum(b * c) AS mwh_uncurt FROM f WHERE tech IN ('SMALL', 'LARGE', 'PROMO') GROUP BY 1, 2, 3, 4",
    "load": "SELECT segment AS rb, year, sum(b) * 3 AS mwh_load FROM f GROUP BY 1, 2",
    "cap": "SELECT tech, status AS vintage, brand AS region, year, sum(a) / 1e6 AS mw FROM f GROUP BY 1, 2, 3, 4",
    "rmap": f"SELECT DISTINCT brand AS rs, concat('p', {BRAND_NO.replace('p_brand', 'brand')} % 5) AS r FROM f WHERE {BRAND_NO.replace('p_brand', 'brand')} < 15",
    "hours": "SELECT DISTINCT concat('h', month % 4 + 1) AS timeslice, 2190 + month % 4 AS hours FROM f",
    "h": "SELECT flag AS model, status AS cr, tech AS e, segment AS rb, year, sum(a) * 1e3 AS dmg, sum(b) AS lives, sum(a) AS em FROM f WHERE year NOT IN (1997, 1999) AND NOT (tech = 'PROMO' AND segment = 'BUILDING' AND year < 1998) GROUP BY 1, 2, 3, 4, 5",
}
# Names of the pipelines' own columns, which SQL texts above leave plain.
RENAME = {"cost": costs.COST, "usd": "$", "mwh": "MWh", "mwh_uncurt": "MWh uncurt", "mwh_load": "MWh load", "mw": "MW",
          "dmg": operation.DAMAGE, "lives": operation.LIVES, "em": operation.TONNES}
DUCK = {"sc": "cost", "vs": "usd"}


NEED = {"sc": "tech segment year", "types": "tech", "crf": "year", "pvf_cap": "year", "pvf_onm": "year",
        "q": "tech status segment month year", "p": "tech status flag segment month year",
        "vs": "tech status segment year flag month", "gen": "tech status segment year", "uncurt": "tech status segment year",
        "load": "segment year", "cap": "tech status brand year", "rmap": "brand", "hours": "month", "h": "flag status tech segment year"}


def _sums():
    return F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("c")).alias("bc")


def roll_up(spark, sf, *keys):
    return facts(spark, sf, *keys, "a", "b", "c").groupBy(*keys).agg(*_sums())


def rolled(spark, sf, *keys):
    """Facts rolled up to the keys, written once for all uses in a query."""
    return materialise(spark, roll_up(spark, sf, *keys))


def covers(names) -> list[tuple[str, ...]]:
    """The largest sets of keys among those that the tables need; every other set is part of one of them."""
    sets = {frozenset(NEED[n].split()) for n in names}
    return sorted(tuple(sorted(s)) for s in sets if not any(s < t for t in sets))


def rolled_to(spark, sf, sets):
    """The facts rolled up to each set of keys in one pass, written once for all uses in a query: (set of keys, rows)."""
    keys = sorted({k for s in sets for k in s})
    if len(sets) == 1:
        d = roll_up(spark, sf, *keys).withColumn("at", F.lit(0))
    else:
        at = F.grouping_id()  # a bit for each key that the set doesn't have
        d = facts(spark, sf, *keys, "a", "b", "c").groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(at.alias("id"), *_sums())
        number = {sum(1 << len(keys) - 1 - i for i, k in enumerate(keys) if k not in s): n for n, s in enumerate(sets)}
        d = d.withColumn("at", F.try_element_at(F.create_map(*[F.lit(v) for kv in number.items() for v in kv]), F.col("id").cast("int"))).drop("id")
    d = materialise(spark, d)
    return [(set(s), d.filter(F.col("at") == n).select(*s, "a", "b", "bc")) for n, s in enumerate(sets)]


def inputs(spark, sf, *names):
    """The derived tables, all from one pass over the facts: each from the smallest roll-up that has its keys."""
    if len(names) == 1:
        parts = [(set(NEED[names[0]].split()), roll_up(spark, sf, *NEED[names[0]].split()))]
    else:
        parts = rolled_to(spark, sf, covers(names))
    out = []
    for n in names:
        text = T[n].replace("AS INTEGER", "AS INT").replace("b * c", "bc")
        f = min((p for p in parts if set(NEED[n].split()) <= p[0]), key=lambda p: len(p[0]))[1]
        d = spark.sql(f"WITH f AS (SELECT * FROM {{f}}) {text}", f=f)
        fixed = {c: F.col(c).cast("double") for c, k in d.dtypes if k.startswith("decimal")}
        d = d.withColumns(fixed) if fixed else d
        out.append(d.withColumnsRenamed({a: b for a, b in RENAME.items() if a in d.columns}))
    return out[0] if len(out) == 1 else out


def sql(names: str, body: str) -> str:
    parts = [f"f AS MATERIALIZED {facts_sql(*LINE)}"] + [f"{n} AS MATERIALIZED ({T[n]})" for n in names.split()]
    return f"WITH {', '.join(parts)}\n{body}"


AREA = "coalesce(rmap.r, cap.region)"
CAP_RB = f"(SELECT tech, vintage, {AREA} AS rb, year, sum(mw) AS mw FROM cap LEFT JOIN rmap ON rs = region GROUP BY 1, 2, 3, 4)"


@query("d1_system_cost", sql("sc", f"""
SELECT cost_cat, r, year, {r(f'cost / {DEFL} * 1e-9')} AS "Cost (Bil $)", {r(f'cost / {DEFL} * 1e-9 / power(1.05, year - 2022)')} AS "Discounted Cost (Bil $)" FROM sc"""))
def _(spark, sf):
    return rounded(costs.system_cost(inputs(spark, sf, "sc")), 4, costs.COST, costs.DISCOUNTED)


@query("d2_objective_cost", sql("sc types pvf_cap pvf_onm", f"""
SELECT sc.cost_cat, r, sc.year, {r(f"cost / {DEFL} * 1e-9 * CASE type WHEN 'Capital' THEN pvfcap WHEN 'Operation' THEN pvfonm ELSE 1 END")} AS "Cost (Bil $)"
FROM sc LEFT JOIN types USING (cost_cat) LEFT JOIN pvf_cap USING (year) LEFT JOIN pvf_onm USING (year)"""))
def _(spark, sf):
    return rounded(costs.objective_cost(*inputs(spark, sf, "sc", "types", "pvf_cap", "pvf_onm")), 4, costs.COST)


@query("j11_unmapped_cost_categories", sql("sc types", "SELECT DISTINCT cost_cat FROM sc WHERE cost_cat NOT IN (SELECT cost_cat FROM types)"))
def _(spark, sf):
    return costs.unmapped_categories(*inputs(spark, sf, "sc", "types"))


CRF_TABLE = """crfs AS (SELECT y.year, CASE WHEN c.crf IS NOT NULL THEN c.crf WHEN y.year < 1996 THEN 0.082 WHEN y.year > 1999 THEN 0.088
 ELSE 0.082 + (0.088 - 0.082) * ((y.year - 1996) / 3.0) END AS crf FROM years y LEFT JOIN crf c ON c.year = y.year)"""


def annual_ctes(n: int, t: int, ids: str, shift: bool, table_crf: bool) -> str:
    """SQL of the annualized costs, as CTEs ending in ``ann``."""
    crf = CRF_TABLE if table_crf else f"crfs AS (SELECT year, 0.05 * power(1.05, {n}) / (power(1.05, {n}) - 1) AS crf FROM years)"
    key = f"{ids}cost_cat"
    inv, factor = ("v", "crf / 1.05") if shift else (f"lag(v) OVER (PARTITION BY {key} ORDER BY d.year)", "crf")
    return f"""years AS (SELECT CAST(unnest(range({1995 - n}, {2001 + max(n, t) + 1})) AS INTEGER) AS year), {crf},
c AS (SELECT {key}, year, avg(cost / {DEFL} * 1e-9) AS v FROM sc GROUP BY ALL),
g AS (SELECT DISTINCT {key}, type FROM c JOIN types USING (cost_cat)),
d AS (SELECT g.*, years.year, c.v FROM g CROSS JOIN years LEFT JOIN c ON c.year = years.year AND c.cost_cat = g.cost_cat{' AND c.r = g.r' if ids else ''}),
s AS (SELECT d.*, coalesce({inv}, 0) * {factor} AS pay FROM d JOIN crfs ON crfs.year = d.year),
w AS (SELECT *, CASE WHEN count(pay) OVER n = {n} THEN sum(pay) OVER n END AS short, CASE WHEN count(pay) OVER t = {t} THEN sum(pay) OVER t END AS long FROM s
 WINDOW n AS (PARTITION BY {key} ORDER BY year ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), t AS (PARTITION BY {key} ORDER BY year ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW)),
o AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY year ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS op FROM w WHERE year >= 1995),
ann AS (SELECT {ids}year, cost_cat, coalesce(CASE WHEN type = 'Operation' THEN op WHEN cost_cat = 'inv_transmission_line_investment' THEN long ELSE short END, 0) AS v FROM o)"""


ANN_OUT = f'{r("v")} AS "Cost (Bil $)", {r("v / power(1.05, year - 2022)")} AS "Discounted Cost (Bil $)"'


def _annual(spark, sf, n=5, t=8, **kw):
    sc, types = inputs(spark, sf, "sc", "types")
    return costs.annualized_cost(sc, types, n, t, **kw)


@query("d3_annualized_cost", sql("sc types", f", {annual_ctes(5, 8, '', False, False)} SELECT year, cost_cat, {ANN_OUT} FROM ann").replace(")\n,", "),\n"))
def _(spark, sf):
    return rounded(_annual(spark, sf), 4, costs.COST, costs.DISCOUNTED)


@query("d3_annualized_cost_by_region", sql("sc types crf", f", {annual_ctes(4, 6, 'r, ', True, True)} SELECT r, year, cost_cat, {ANN_OUT} FROM ann").replace(")\n,", "),\n")
       .replace("GROUP BY ALL", "GROUP BY r, cost_cat, year").replace("g.*, years.year", "g.r, g.cost_cat, g.type, years.year")
       .replace("SELECT DISTINCT r, cost_cat, type FROM c JOIN types USING (cost_cat)", "SELECT a.r, b.cost_cat, b.type FROM (SELECT DISTINCT r FROM c) a CROSS JOIN (SELECT DISTINCT cost_cat, type FROM c JOIN types USING (cost_cat)) b"))
def _(spark, sf):
    crf = inputs(spark, sf, "crf")
    return rounded(_annual(spark, sf, 4, 6, crf=crf, by_region=True, shift_capital=True), 4, costs.COST, costs.DISCOUNTED)


@query("d3_annualized_cost_with_history", sql("sc types rmap", f""", {annual_ctes(5, 8, '', False, False)}
SELECT year, cost_cat, {ANN_OUT} FROM ann""").replace(")\n,", "),\n").replace(
    "d AS (SELECT g.*, years.year, c.v FROM g", f"""h AS (SELECT x.t AS year, sum(capex) / 1e9 / {DEFL} AS capex FROM (SELECT year - 4 AS t, brand AS region, sum(a) * 1e3 AS capex FROM f GROUP BY 1, 2) x
 WHERE region IN (SELECT rs FROM rmap) AND (SELECT r FROM rmap WHERE rs = region) IN ('p1', 'p2') GROUP BY 1),
d AS (SELECT g.*, years.year, CASE WHEN g.cost_cat = 'inv_investment_capacity_costs' AND years.year < 1995 THEN h.capex ELSE c.v END AS v FROM g""").replace(
    "AND c.cost_cat = g.cost_cat)", "AND c.cost_cat = g.cost_cat LEFT JOIN h ON h.year = years.year)"))
def _(spark, sf):
    capex = materialise(spark, facts(spark, sf, "year", "brand", "a").groupBy((F.col("year") - 4).alias("t"), F.col("brand").alias("region")).agg((F.sum("a") * 1e3).alias("capex")))
    rmap = inputs(spark, sf, "rmap")
    valid = rmap.select("r").filter("r IN ('p1', 'p2')").distinct()
    history = costs.historical_capex(capex, rmap, valid, by_region=False)
    return rounded(_annual(spark, sf, history=history), 4, costs.COST, costs.DISCOUNTED)


@query("d4_average_price_national", sql("sc types q", f""", {annual_ctes(5, 8, '', True, False)},
l AS (SELECT year, sum(q) AS q FROM q WHERE type = 'load' AND year <> 1998 GROUP BY 1),
y AS (SELECT CAST(unnest(range(1995, 2010)) AS INTEGER) AS year),
lf AS (SELECT y.year, last_value(q IGNORE NULLS) OVER (ORDER BY y.year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM y LEFT JOIN l ON l.year = y.year)
SELECT ann.year, cost_cat, q, {ANN_OUT.replace('year -', 'ann.year -')}, {r('v * 1e9 / q', 2)} AS "Average cost ($/MWh)" FROM ann JOIN lf ON lf.year = ann.year""").replace(")\n,", "),\n"))
def _(spark, sf):
    q = inputs(spark, sf, "q").filter("year <> 1998")
    d = costs.average_price_national(_annual(spark, sf, shift_capital=True), q)
    return rounded(rounded(d, 4, costs.COST, costs.DISCOUNTED), 2, "Average cost ($/MWh)")


# Regional average price: capital and operation, existing capacity, capacity and energy trade.
REGION_CTES = f"""rc AS (SELECT cost_cat, coalesce(m.r, s.region) AS region, year, sum(v) AS v FROM (SELECT {case('tech', COST_CATS)} AS cost_cat, brand AS region, year, sum(a) * 1e4 / {DEFL} * 1e-9 AS v FROM f WHERE year NOT IN (1996, 1999) GROUP BY 1, 2, 3) s LEFT JOIN rmap m ON m.rs = s.region GROUP BY 1, 2, 3),
years AS (SELECT CAST(unnest(range(1976, 2022)) AS INTEGER) AS year), {CRF_TABLE},
g AS (SELECT DISTINCT region, cost_cat, type FROM rc JOIN types USING (cost_cat)),
d AS (SELECT g.region, g.cost_cat, g.type, years.year, rc.v FROM g CROSS JOIN years LEFT JOIN rc ON rc.region = g.region AND rc.cost_cat = g.cost_cat AND rc.year = years.year),
s AS (SELECT d.*, coalesce(lag(v) OVER (PARTITION BY region, cost_cat ORDER BY d.year), 0) * crf AS pay FROM d JOIN crfs ON crfs.year = d.year),
w AS (SELECT *, CASE WHEN count(pay) OVER n = 20 THEN sum(pay) OVER n END AS capital FROM s WINDOW n AS (PARTITION BY region, cost_cat ORDER BY year ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY region, cost_cat ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS op FROM w WHERE year >= 1995),
lg AS (SELECT year, region, cost_cat, coalesce(CASE WHEN type = 'Capital' THEN capital WHEN year = 2021 THEN 0 ELSE op END, 0) AS v FROM o),
ex AS (SELECT year, brand AS region, sum(b) / {DEFL} AS old FROM f WHERE {BRAND_NO.replace('p_brand', 'brand')} >= 15 GROUP BY 1, 2),
rcost AS (SELECT y.year, a.region, k.cost_cat, coalesce(lg.v, 0) + CASE WHEN k.cost_cat = 'inv_investment_capacity_costs' THEN coalesce(ex.old, 0) ELSE 0 END AS v
 FROM (SELECT DISTINCT year FROM lg) y CROSS JOIN (SELECT DISTINCT region FROM lg) a CROSS JOIN (SELECT DISTINCT cost_cat FROM lg) k
 LEFT JOIN lg ON lg.year = y.year AND lg.region = a.region AND lg.cost_cat = k.cost_cat LEFT JOIN ex ON ex.year = y.year AND ex.region = a.region)"""


def _regional(spark, sf):
    types, rmap, crf = inputs(spark, sf, "types", "rmap", "crf")
    f = rolled(spark, sf, "tech", "brand", "year")
    sc = f.filter("year NOT IN (1996, 1999)").groupBy(F.expr(case("tech", COST_CATS)).alias("cost_cat"), F.col("brand").alias("region"), "year").agg((F.sum("a") * 1e4).alias(costs.COST))
    old = f.filter("CAST(substring(brand, 7) AS INT) >= 15").groupBy("year", F.col("brand").alias("region")).agg(F.sum("b").alias("existingcap"))
    return costs.regional_cost(sc, types, rmap, crf, old)


@query("d5_regional_cost", sql("types rmap crf", f', {REGION_CTES} SELECT year, region, cost_cat, {r("v")} AS "Cost (Bil $)" FROM rcost').replace(")\n,", "),\n"))
def _(spark, sf):
    return rounded(_regional(spark, sf), 4, costs.COST)


FLOW = ("from_nation", "rb", "year", "month", "a", "b", "tech")
FLOWS = f"fl AS MATERIALIZED (SELECT concat('NATION_', from_nation) AS r, rb AS rr, {SEASON} AS slot, year, sum(a) AS a, sum(b) AS b FROM {facts_sql(*FLOW)} GROUP BY 1, 2, 3, 4)"
NODE = "nd AS MATERIALIZED (SELECT r, slot, year, sum(a) AS a, sum(b) AS b FROM fl GROUP BY 1, 2, 3)"
CAP_TRADE = f"""ct AS (SELECT fl.r, fl.rr, fl.year, nd.a / nd.b / 1000 * fl.b * 1e3 / 1e9 AS cost FROM fl JOIN nd ON nd.r = fl.r AND nd.slot = fl.slot AND nd.year = fl.year WHERE nd.slot <> 'q4'),
captrade AS (SELECT year, rr AS region, 'cap_trade_import_cost' AS cost_cat, sum(cost) AS v FROM ct GROUP BY 1, 2 UNION ALL SELECT year, r, 'cap_trade_export_cost', -sum(cost) FROM ct GROUP BY 1, 2)"""


def _flows(spark, sf):
    f = facts(spark, sf, *FLOW)
    return materialise(spark, f.groupBy(F.expr("concat('NATION_', from_nation)").alias("r"), F.col("rb").alias("rr"), F.expr(SEASON.replace("INTEGER", "INT")).alias("timeslice"), "year").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def _node_price(fl, kind, keep):
    nd = fl.groupBy("r", "timeslice", "year").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return nd.filter(keep).select(F.lit(kind).alias("type"), F.lit("na").alias("subtype"), F.col("r").alias("rb"), "timeslice", "year", S.ratio(S.ratio("a", "b"), F.lit(1000)).alias("p"))


def _capacity_trade(fl):
    amount = fl.select(F.col("r").alias("rb_out"), F.col("rr").alias("rb_in"), F.col("timeslice").alias("season"), "year", F.col("b").alias("Amount (MW)"))
    return costs.capacity_trade_cost(amount, _node_price(fl, "res_marg", "timeslice <> 'q4'"))


def _energy_trade(fl):
    gen = fl.select("r", "timeslice", "year", (F.col("b") / 1000).alias("Generation (GW)"))
    frac = fl.select("r", "rr", "timeslice", "year", (F.col("b") / 5000).alias("frac"))
    hours = fl.select("timeslice").distinct().withColumn("hours", F.lit(2190))
    return costs.energy_trade_cost(gen, _node_price(fl, "load", "year <> 1999"), frac, frac, hours)


ENERGY_TRADE = """px AS (SELECT r, slot, year, a / b / 1000 AS p FROM nd WHERE year <> 1999),
im AS (SELECT fl.year, fl.r AS region, 'energy_trade_import_cost' AS cost_cat, sum(coalesce(fl.b / 5000 * (nd.b / 1000) * p * 2190 / 1e9, 0)) AS v FROM fl JOIN nd ON nd.r = fl.r AND nd.slot = fl.slot AND nd.year = fl.year
 LEFT JOIN px ON px.r = fl.rr AND px.slot = fl.slot AND px.year = fl.year WHERE fl.r <> fl.rr GROUP BY 1, 2),
sold AS (SELECT rr AS r, slot, year, sum(b / 5000) AS frac FROM fl WHERE r <> rr GROUP BY 1, 2, 3),
exx AS (SELECT sold.year, sold.r AS region, 'energy_trade_export_cost' AS cost_cat, -sum(coalesce(frac * (nd.b / 1000) * p * 2190 / 1e9, 0)) AS v FROM sold LEFT JOIN nd ON nd.r = sold.r AND nd.slot = sold.slot AND nd.year = sold.year
 LEFT JOIN px ON px.r = sold.r AND px.slot = sold.slot AND px.year = sold.year GROUP BY 1, 2),
entrade AS (SELECT * FROM im UNION ALL SELECT * FROM exx)"""


@query("d6_capacity_trade_cost", f'WITH {FLOWS}, {NODE}, {CAP_TRADE} SELECT year, region, cost_cat, {r("v * 1e3")} AS "Cost (Bil $)" FROM captrade')
def _(spark, sf):
    d = _capacity_trade(_flows(spark, sf))
    return rounded(d.withColumn(costs.COST, F.col(costs.COST) * 1e3), 4, costs.COST)


@query("d7_energy_trade_cost", f'WITH {FLOWS}, {NODE}, {ENERGY_TRADE} SELECT year, region, cost_cat, {r("v * 1e3")} AS "Cost (Bil $)" FROM entrade')
def _(spark, sf):
    d = _energy_trade(_flows(spark, sf))
    return rounded(d.withColumn(costs.COST, F.col(costs.COST) * 1e3), 4, costs.COST)


# Quotients of sums near 1e9: two decimals are what they carry.
@query("d8_average_price_regional", sql("types rmap crf", f""", {REGION_CTES}, {FLOWS}, {NODE}, {CAP_TRADE}, {ENERGY_TRADE},
ld AS (SELECT year, rb, sum(b) AS q FROM {facts_sql('rb', 'year', 'tech', 'b')} WHERE tech = 'ECONOMY' AND year <> 1997 GROUP BY 1, 2)
SELECT t.year, t.region AS rb, cost_cat, q AS "load (MWh)", {r('v * 1e9 / q + 0.00013', 2)} AS "Average cost ($/MWh)" FROM (SELECT year, 'NATION_' || CAST(TRY_CAST(substring(region, 7) AS INTEGER) % 25 AS VARCHAR) AS region, cost_cat, v FROM rcost UNION ALL SELECT * FROM captrade UNION ALL SELECT * FROM entrade) t JOIN ld ON ld.year = t.year AND ld.rb = t.region""").replace(")\n,", "),\n"))
def _(spark, sf):
    q = facts(spark, sf, "rb", "year", "tech", "b").filter("year <> 1997").groupBy(F.expr(case("tech", REQUIREMENTS)).alias("type"), "rb", "year").agg(F.sum("b").alias("q"))
    fl = _flows(spark, sf)
    # Brands stand for regions in D5; here they lie in nations.
    own = _regional(spark, sf).withColumn("region", F.expr("concat('NATION_', try_cast(substring(region, 7) AS INT) % 25)"))
    d = costs.average_price_regional([own, _capacity_trade(fl), _energy_trade(fl)], q)
    # Quotients of cents by whole loads often end in half a cent: a shift in both texts keeps them off the tie.
    d = d.withColumn("Average cost ($/MWh)", F.col("Average cost ($/MWh)") + 0.00013)
    return rounded(d.drop(costs.COST), 2, "Average cost ($/MWh)")


@query("d9_abatement_objective", sql("sc types pvf_cap pvf_onm", f"""
SELECT sc.cost_cat, r, sc.year, {r(f"cost / {DEFL} * 1e-9 * CASE type WHEN 'Capital' THEN pvfcap WHEN 'Operation' THEN pvfonm ELSE 1 END")} AS val, 'Cost (Bil $)' AS type
FROM sc LEFT JOIN types USING (cost_cat) LEFT JOIN pvf_cap USING (year) LEFT JOIN pvf_onm USING (year)
UNION ALL SELECT 'CO2 (Bil metric ton)', NULL, e.year, {r('v * 1e-3 * pvfonm')}, 'CO2 (Bil metric ton)' FROM (SELECT year, sum(b) AS v FROM f GROUP BY 1) e LEFT JOIN pvf_onm USING (year)"""))
def _(spark, sf):
    sc, types, pc, po = inputs(spark, sf, "sc", "types", "pvf_cap", "pvf_onm")
    emit = facts(spark, sf, "year", "b").groupBy("year").agg(F.sum("b").alias("CO2 (MMton)"))
    d = costs.abatement_objective(costs.objective_cost(sc, types, pc, po), emit, po)
    return rounded(d, 4, "val").select("cost_cat", "r", "year", "val", "type")


@query("d10_abatement_annualized", sql("sc types", f""", {annual_ctes(5, 8, '', False, False)},
e AS (SELECT year, sum(b) * 1e-3 AS v FROM f WHERE year <> 1998 GROUP BY 1), y AS (SELECT CAST(unnest(range(1995, 2010)) AS INTEGER) AS year),
u AS (SELECT year, cost_cat, sum(v) AS val, 'Cost (Bil $)' AS type FROM ann GROUP BY 1, 2 UNION ALL
 SELECT y.year, 'CO2 (Bil metric ton)', last_value(v IGNORE NULLS) OVER (ORDER BY y.year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'CO2 (Bil metric ton)' FROM y LEFT JOIN e ON e.year = y.year)
SELECT year, cost_cat, type, {r('val')} AS val, {r('val / power(1.05, year - 2022)')} AS "disc val", {r('sum(val) OVER w')} AS "cum val", {r('sum(val / power(1.05, year - 2022)) OVER w')} AS "cum disc val" FROM u
WINDOW w AS (PARTITION BY cost_cat ORDER BY year)""").replace(")\n,", "),\n"))
def _(spark, sf):
    emit = facts(spark, sf, "year", "b").filter("year <> 1998").groupBy("year").agg(F.sum("b").alias("CO2 (MMton)"))
    d = costs.abatement_annualized(_annual(spark, sf), emit)
    return rounded(d, 4, "val", "disc val", "cum val", "cum disc val")


@query("d11_region_rollup", sql("cap rmap", f"SELECT tech, {AREA} AS rb, year, {r('sum(mw)', 8)} AS \"MW\" FROM cap LEFT JOIN rmap ON rs = region GROUP BY 1, 2, 3"))
def _(spark, sf):
    cap, rmap = inputs(spark, sf, "cap", "rmap")
    return rounded(regions.to_balancing_area(cap, rmap, ["tech", "rb", "year"]), 8, "MW")


@query("d12_cooling_water", sql("gen", """SELECT g.tech, g.vintage, g.rb, g.year, coalesce(c.ctt, 'none') AS ctt, coalesce(c.wst, 'other') AS wst FROM (SELECT lower(tech) AS tech, vintage, rb, year FROM gen) g
LEFT JOIN (SELECT DISTINCT lower(tech) AS tech, min(status) OVER (PARTITION BY tech) AS ctt, min(flag) OVER (PARTITION BY tech) AS wst FROM f WHERE tech <> 'PROMO') c USING (tech)"""))
def _(spark, sf):
    gen = inputs(spark, sf, "gen").select(F.lower("tech").alias("tech"), "vintage", "rb", "year")
    cooling = facts(spark, sf, "tech", "status", "flag").filter("tech <> 'PROMO'").groupBy("tech").agg(F.min("status").alias("ctt"), F.min("flag").alias("wst"))
    return regions.add_cooling_water(gen, cooling)


@query("d13_generation_with_load", sql("gen uncurt", f"""
, a AS (SELECT tech, year, sum(mwh) AS g FROM gen WHERE tech <> 'SMALL' GROUP BY 1, 2), b AS (SELECT tech, year, sum(mwh_uncurt) AS u FROM uncurt GROUP BY 1, 2),
m AS (SELECT tech, year, coalesce(g, 0) * 1e-6 AS g, coalesce(u, coalesce(g, 0)) * 1e-6 AS u FROM a FULL JOIN b USING (tech, year)),
l AS (SELECT year, avg(CASE WHEN flag = 'A' THEN v END) AS load, avg(CASE WHEN flag = 'N' AND status = 'F' THEN v END) AS storage, avg(CASE WHEN flag = 'R' THEN v END) AS trans, avg(CASE WHEN flag = 'N' AND status = 'O' THEN v END) AS curt
 FROM (SELECT year, flag, status, sum(b) * 1e-6 AS v FROM f GROUP BY 1, 2, 3) GROUP BY 1)
SELECT tech, m.year, {r('g', 8)} AS "Gen (TWh)", {r('u', 8)} AS "Gen Uncurt (TWh)", {r('g / load', 6)} AS "Gen Frac of Load", {r('g / (load + storage + trans)', 6)} AS "Gen Frac of Load Plus Stor/Trans Loss",
{r('u / load', 6)} AS "Gen Uncurt Frac of Load", {r('u / (load + storage + trans + curt)', 6)} AS "Gen Uncurt Frac of Load Plus All Losses" FROM m LEFT JOIN l ON l.year = m.year""").replace(")\n\n,", "),\n"))
def _(spark, sf):
    gen, un = inputs(spark, sf, "gen", "uncurt")
    load = facts(spark, sf, "year", "flag", "status", "b").groupBy("year", "flag", "status").agg(F.sum("b").alias("TWh")).select(
        "year", F.expr("CASE WHEN flag = 'A' THEN 'load' WHEN flag = 'R' THEN 'trans' WHEN status = 'F' THEN 'storage' ELSE 'curt' END").alias("type"), "TWh")
    d = operation.generation_with_load(gen.filter("tech <> 'SMALL'").withColumnRenamed("MWh", "Gen (TWh)"), un.withColumnRenamed("MWh uncurt", "Gen Uncurt (TWh)"), load)
    d = d.drop("load", "storage", "trans", "curt")
    return rounded(rounded(d, 8, "Gen (TWh)", "Gen Uncurt (TWh)"), 6, *[c for c in d.columns if " Frac " in c])


STREAM_SQL = f"""rows AS (SELECT tech, vintage, rb, vs.year, var_name, con_name, usd / {DEFL} / 100 / pvfcap AS v FROM vs LEFT JOIN pvf_cap USING (year)
 UNION ALL SELECT tech, vintage, rb, gen.year, 'MWh', 'MWh', mwh * pvfonm / pvfcap FROM gen LEFT JOIN pvf_cap USING (year) LEFT JOIN pvf_onm USING (year)
 UNION ALL SELECT tech, vintage, rb, year, 'kW', 'kW', mw * 1000 FROM {CAP_RB})"""


STREAM_INPUTS = ("vs", "gen", "cap", "pvf_cap", "pvf_onm", "rmap")


def _streams(vs, gen, cap, pc, po, rmap):
    return value.value_streams(vs, gen, cap, pc, po, 100.0, rmap)


@query("d14_value_streams", sql("vs gen cap pvf_cap pvf_onm rmap", f""", {STREAM_SQL}
SELECT tech, vintage, rb, year, var_name, con_name, {r('v', 5)} AS "Bulk $", {r('v / power(1.05, year - 2022)', 2)} AS "Bulk $ Dis", tech || ', ' || vintage AS "tech, vintage", var_name || ', ' || con_name AS "var, con",
CASE WHEN con_name IN ('eq_objfn_inv', 'eq_objfn_op') THEN var_name || ', ' || con_name ELSE con_name END AS con_adj FROM rows""").replace(")\n,", "),\n"))
def _(spark, sf):
    return rounded(rounded(_streams(*inputs(spark, sf, *STREAM_INPUTS)), 5, "Bulk $"), 2, "Bulk $ Dis")


@query("d14_uncurtailed_generation", sql("gen uncurt", """SELECT tech, vintage, rb, year, mwh AS "MWh" FROM gen WHERE tech NOT IN (SELECT tech FROM uncurt)
UNION ALL SELECT tech, vintage, rb, year, round(mwh_uncurt, 4) FROM uncurt"""))
def _(spark, sf):
    gen, un = inputs(spark, sf, "gen", "uncurt")
    return value.prefer_uncurtailed(gen, rounded(un.withColumnRenamed("MWh uncurt", "MWh"), 4, "MWh"))


@query("d14_without_investments", sql("vs", "SELECT tech, vintage, rb, year, var_name, con_name, round(usd, 2) AS \"$\" FROM vs WHERE var_name <> 'inv'"))
def _(spark, sf):
    return rounded(value.without_investments(inputs(spark, sf, "vs")), 2, "$")


LINKS = "'eq_cap_new_noret', 'eq_cap_new_retub', 'eq_cap_new_retmo', 'eq_cap_upgrade', 'eq_captran'"


@query("d15_investment_only", sql("vs", f"""
, m AS (SELECT tech, vintage, rb, year, sum(CASE WHEN var_name = 'inv' THEN usd END) / nullif(sum(CASE WHEN var_name = 'cap' THEN usd END), 0) * -1 AS mult FROM vs WHERE con_name IN ({LINKS}) GROUP BY 1, 2, 3, 4
 HAVING sum(CASE WHEN var_name = 'inv' THEN usd END) IS NOT NULL AND sum(CASE WHEN var_name = 'cap' THEN usd END) IS NOT NULL)
SELECT tech, vintage, rb, year, var_name, con_name, {r('usd', 2)} AS "$" FROM vs WHERE var_name = 'inv'
UNION ALL SELECT m.tech, m.vintage, m.rb, m.year, c.var_name, c.con_name, {r('c.usd * mult', 2)} FROM m LEFT JOIN (SELECT * FROM vs WHERE var_name IN ('gen', 'cap')) c ON c.tech = m.tech AND c.vintage = m.vintage AND c.rb = m.rb AND c.year = m.year""").replace(")\n\n,", "),\n"))
def _(spark, sf):
    vs, gen = inputs(spark, sf, "vs", "gen")
    return rounded(value.investment_only(vs, gen)[0], 2, "$")


FACTORS = ["$ all-in loc", "$ all-in sys", "$ flat loc", "$ flat sys"]


@query("d16_value_factors", sql("vs gen q p pvf_onm hours", f"""
, e AS (SELECT tech, rb, year, sum(mwh) AS m FROM gen GROUP BY 1, 2, 3),
st AS (SELECT tech, rb, year, con_name, sum(usd / {DEFL}) AS v FROM vs WHERE con_name IN ({_names(value.VALUE_STREAMS)}) GROUP BY 1, 2, 3, 4),
full_ AS (SELECT k.tech, k.rb, k.year, c.con_name, coalesce(st.v, 0) / 100 / pvfonm AS v FROM (SELECT DISTINCT tech, rb, year FROM st) k CROSS JOIN (SELECT DISTINCT con_name FROM st) c
 LEFT JOIN st ON st.tech = k.tech AND st.rb = k.rb AND st.year = k.year AND st.con_name = c.con_name LEFT JOIN pvf_onm o ON o.year = k.year),
bm AS (SELECT q.rb, q.timeslice, q.year, q.q, coalesce(p.p / {DEFL}, 0) AS p, CASE q.type WHEN 'load' THEN 'eq_supply_demand_balance' WHEN 'res_marg' THEN 'eq_reserve_margin' WHEN 'oper_res' THEN 'eq_opres_requirement' WHEN 'state_rps' THEN 'eq_rec_requirement' END AS con_name
 FROM q LEFT JOIN p ON p.type = q.type AND p.subtype = q.subtype AND p.rb = q.rb AND p.timeslice = q.timeslice AND p.year = q.year WHERE q.type IN ('load', 'res_marg', 'oper_res', 'state_rps')),
ld AS (SELECT rb, year, sum(q) AS l FROM q WHERE type = 'load' GROUP BY 1, 2),
lo AS (SELECT con_name, bm.rb, bm.year, sum(p * q) AS v, any_value(l) AS l FROM bm LEFT JOIN ld ON ld.rb = bm.rb AND ld.year = bm.year GROUP BY 1, 2, 3),
sy AS (SELECT con_name, year, sum(v) / sum(l) AS x FROM lo GROUP BY 1, 2),
fl AS (SELECT con_name, rb, year, sum(CASE WHEN con_name = 'eq_supply_demand_balance' THEN p * hours / 1000 ELSE p END) / 8.76 AS x FROM bm JOIN hours USING (timeslice) WHERE con_name IN ('eq_supply_demand_balance', 'eq_reserve_margin') GROUP BY 1, 2, 3),
fs AS (SELECT con_name, fl.year, sum(x * l) / sum(l) AS x FROM fl LEFT JOIN ld ON ld.rb = fl.rb AND ld.year = fl.year GROUP BY 1, 2)
SELECT u.tech, u.rb, u.year, u.con_name, {r('u.v', 3)} AS "$", {r('coalesce(lo.v / lo.l * m, 0)', 2)} AS "$ all-in loc", {r('coalesce(sy.x * m, 0)', 2)} AS "$ all-in sys", {r('coalesce(fl.x * m, 0)', 2)} AS "$ flat loc", {r('coalesce(fs.x * m, 0)', 2)} AS "$ flat sys" FROM full_ u
LEFT JOIN lo ON lo.con_name = u.con_name AND lo.rb = u.rb AND lo.year = u.year LEFT JOIN sy ON sy.con_name = u.con_name AND sy.year = u.year
LEFT JOIN fl ON fl.con_name = u.con_name AND fl.rb = u.rb AND fl.year = u.year LEFT JOIN fs ON fs.con_name = u.con_name AND fs.year = u.year
LEFT JOIN e ON e.tech = u.tech AND e.rb = u.rb AND e.year = u.year
UNION ALL SELECT tech, rb, year, 'MWh', {r('m', 3)}, {r('m', 2)}, {r('m', 2)}, {r('m', 2)}, {r('m', 2)} FROM e""").replace(")\n\n,", "),\n"))
def _(spark, sf):
    vs, gen, q, p, po, hours = inputs(spark, sf, "vs", "gen", "q", "p", "pvf_onm", "hours")
    return rounded(rounded(value.value_factors(vs, gen, q, p, po, 100.0, hours), 3, "$"), 2, *FACTORS)


PRICE_SQL = f"""c AS (SELECT q.type, q.subtype, q.rb, q.timeslice, q.year, coalesce(p.p / {DEFL}, 0) * q.q AS v FROM q LEFT JOIN p ON p.type = q.type AND p.subtype = q.subtype AND p.rb = q.rb AND p.timeslice = q.timeslice AND p.year = q.year),
prices AS (SELECT * FROM c UNION ALL SELECT 'tot', 'na', rb, timeslice, year, sum(v) FROM c WHERE type IN ('load', 'res_marg', 'oper_res', 'state_rps', 'nat_gen') GROUP BY 3, 4, 5
 UNION ALL SELECT 'q_' || type, subtype, rb, timeslice, year, q FROM q)"""


@query("d17_competitiveness", sql("vs gen cap pvf_cap pvf_onm rmap q p", f""", {STREAM_SQL}, {PRICE_SQL},
b AS (SELECT year, sum(CASE WHEN type IN ('load', 'res_marg', 'oper_res', 'state_rps') THEN v END) / sum(CASE WHEN type = 'q_load' THEN v END) AS pb FROM prices GROUP BY 1),
t AS (SELECT tech, vintage, rb, year, -sum(CASE WHEN con_name IN ({_names(value.COST_STREAMS)}) THEN v / power(1.05, year - 2022) END) AS cost, sum(CASE WHEN con_name = 'MWh' THEN v / power(1.05, year - 2022) END) AS mwh,
 sum(CASE WHEN con_name IN ({_names(value.VALUE_STREAMS)}) THEN v / power(1.05, year - 2022) END) AS val FROM rows GROUP BY 1, 2, 3, 4)
SELECT tech, vintage, rb, t.year, {r('cost / mwh')} AS "LCOE", {r('val / mwh')} AS "LVOE", {r('val / mwh - cost / mwh')} AS "NVOE", {r('val / cost')} AS "BCR", {r('pb * cost / val')} AS "PLCOE", {r('val / mwh / pb')} AS "value factor",
{r('pb - val / mwh')} AS "integration cost", {r('cost / mwh + pb - val / mwh')} AS "SLCOE" FROM t JOIN b ON b.year = t.year WHERE cost IS NOT NULL""").replace(")\n,", "),\n"))
def _(spark, sf):
    *streams, q, p = inputs(spark, sf, *STREAM_INPUTS, "q", "p")
    d = value.competitiveness(_streams(*streams), value.requirement_prices(q, p))
    d = d.drop("Cost $", "MWh", "Value $", "P_b")
    return rounded(d, 4, *[c for c in d.columns if c not in value.INDEX])


@query("d18_requirement_prices", sql("q p", f""", {PRICE_SQL} SELECT type, subtype, rb, timeslice, year, {r('v', 2)} AS "$" FROM prices""").replace(")\n,", "),\n"))
def _(spark, sf):
    return rounded(value.requirement_prices(*inputs(spark, sf, "q", "p")), 2, "$")


@query("d19_gas_price", f"""WITH f AS {facts_sql('segment', 'year', 'flag', 'a', 'b')}
SELECT segment AS census, year, {r('sum(b)', 2)} AS q, {r(f"coalesce(sum(CASE WHEN flag = 'A' AND year <> 1998 THEN a END) / sum(CASE WHEN flag = 'A' AND year <> 1998 THEN b END) / {DEFL}, 0)")} AS p FROM f GROUP BY 1, 2""")
def _(spark, sf):
    f = facts(spark, sf, "segment", "year", "flag", "a", "b").withColumnRenamed("segment", "census")
    q = f.groupBy("census", "year").agg(F.sum("b").alias("q"))
    p = f.filter("flag = 'A' AND year <> 1998").groupBy("census", "year").agg(S.ratio(F.sum("a"), F.sum("b")).alias("p"))
    return rounded(rounded(value.gas_price(q, p), 4, "p"), 2, "q")


@query("d20_levelized_cost", f"""WITH f AS MATERIALIZED {facts_sql('tech', 'status', 'segment', 'year', 'flag', 'month', 'a', 'b')},
l AS (SELECT tech, status AS vintage, segment AS region, year, flag AS bin, sum(a) / sum(b) AS c FROM f GROUP BY 1, 2, 3, 4, 5),
av AS (SELECT tech, segment AS region, year, flag AS bin, sum(b) AS mw FROM f WHERE month = 5 GROUP BY 1, 2, 3, 4), ch AS (SELECT tech, status AS vintage, segment AS region, year, flag AS bin, sum(b) AS mw FROM f WHERE month = 7 AND status = 'F' GROUP BY 1, 2, 3, 4, 5)
SELECT l.tech, l.vintage, l.region, l.year, l.bin, {r(f'c / {DEFL}')} AS "$/MWh", coalesce(av.mw, 0) AS "available MW", CASE WHEN av.mw > 0.001 THEN 'yes' ELSE 'no' END AS available, coalesce(ch.mw, 0) AS "chosen MW",
CASE WHEN coalesce(ch.mw, 0) <> 0 THEN 'yes' ELSE 'no' END AS chosen, l.tech || ' | ' || l.vintage || ' | ' || l.region || ' | ' || l.bin AS icrb FROM l
LEFT JOIN av ON av.tech = l.tech AND av.region = l.region AND av.year = l.year AND av.bin = l.bin LEFT JOIN ch ON ch.tech = l.tech AND ch.vintage = l.vintage AND ch.region = l.region AND ch.year = l.year AND ch.bin = l.bin""")
def _(spark, sf):
    f = rolled(spark, sf, "tech", "status", "segment", "year", "flag", "month").drop("bc").toDF("tech", "vintage", "region", "year", "bin", "month", "a", "b")
    key = ["tech", "region", "year", "bin"]
    lcoe = f.groupBy("tech", "vintage", *key[1:]).agg(S.ratio(F.sum("a"), F.sum("b")).alias("$/MWh"))
    avail = f.filter("month = 5").groupBy(*key).agg(F.sum("b").alias("available MW"))
    inv = f.filter("month = 7 AND vintage = 'F'").groupBy("tech", "vintage", *key[1:]).agg(F.sum("b").alias("chosen MW"))
    return rounded(operation.levelized_cost(lcoe, avail, inv), 4, "$/MWh")


@query("d21_reduced_cost_key", "SELECT p_type || ' | ' || p_brand || ' | ' || p_size || ' | ' || p_name AS irbv, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_type").alias("tech"), F.col("p_brand").alias("region"), F.col("p_size").alias("bin"), F.col("p_name").alias("variable"))
    return operation.reduced_cost(d).groupBy("irbv").agg(F.count(F.lit(1)).alias("n"))


def _slice_tables(spark, sf):
    f = facts(spark, sf, "tech", "segment", "month", "year", "flag", "b", "c").toDF("tech", "region", "month", "year", "flag", "b", "c")
    f = f.withColumn("timeslice", F.expr("concat('h', month % 4 + 1)"))
    key = ["tech", "region", "timeslice", "year"]
    return (f.groupBy(*key).agg(F.sum("b").alias("MWh uncurt")),
            f.filter("flag = 'R' AND year <> 2000").groupBy(*key).agg((F.avg("c") - 1).alias("Curt Rate")))


SLICES = f"f AS MATERIALIZED (SELECT *, concat('h', month % 4 + 1) AS timeslice FROM {facts_sql('tech', 'segment', 'month', 'year', 'flag', 'b', 'c')}), g AS (SELECT tech, segment AS region, timeslice, year, sum(b) AS u FROM f GROUP BY 1, 2, 3, 4), k AS (SELECT tech, segment AS region, timeslice, year, avg(c) - 1 AS rate FROM f WHERE flag = 'R' AND year <> 2000 GROUP BY 1, 2, 3, 4)"


@query("d22_curtailment_of_new", f"""WITH {SLICES} SELECT g.tech, g.region, g.timeslice, g.year, u AS "MWh uncurt", {r('coalesce(rate, 0)', 6)} AS "Curt Rate" FROM g LEFT JOIN k USING (tech, region, timeslice, year)""")
def _(spark, sf):
    return rounded(operation.curtailment_of_new(*_slice_tables(spark, sf)), 6, "Curt Rate")


@query("d22_curtailment_of_new_annual", f"""WITH {SLICES} SELECT tech, region, year, sum(u) AS "MWh uncurt", {r('sum(coalesce(rate, 0) * u)')} AS "MWh curt", {r('coalesce(sum(coalesce(rate, 0) * u) / sum(u), 0)', 6)} AS "Curt Rate" FROM g LEFT JOIN k USING (tech, region, timeslice, year) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(rounded(operation.curtailment_of_new(*_slice_tables(spark, sf), annual=True), 6, "Curt Rate"), 4, "MWh curt")


@query("d23_curtailment", sql("uncurt gen load", f"""
SELECT u.tech, u.vintage, u.rb, u.year, {r('mwh_uncurt', 3)} AS "MWh uncurt", coalesce(g.mwh, 0) AS "MWh", {r('1 - coalesce(g.mwh, 0) / mwh_uncurt', 6)} AS "Curt Rate",
{r('sum(mwh_uncurt) OVER (PARTITION BY u.rb, u.year) / mwh_load', 6)} AS "VRE penetration n", {r('sum(mwh_uncurt) OVER (PARTITION BY u.year) / (SELECT sum(mwh_load) FROM load l2 WHERE l2.year = u.year)', 6)} AS "VRE penetration nat"
FROM uncurt u LEFT JOIN (SELECT * FROM gen WHERE tech <> 'PROMO') g ON g.tech = u.tech AND g.vintage = u.vintage AND g.rb = u.rb AND g.year = u.year LEFT JOIN load l ON l.rb = u.rb AND l.year = u.year"""))
def _(spark, sf):
    un, gen, load = inputs(spark, sf, "uncurt", "gen", "load")
    d = operation.curtailment(un, gen.filter("tech <> 'PROMO'"), load)
    return rounded(rounded(d, 6, "Curt Rate", "VRE penetration n", "VRE penetration nat"), 3, "MWh uncurt")


@query("d24_curtailment_iterations", sql("uncurt gen", """SELECT tech, vintage, rb, year, round(mwh, 4) AS "MWh", 'gen' AS type FROM gen WHERE tech IN (SELECT tech FROM uncurt)
UNION ALL SELECT tech, vintage, rb, year, round(mwh_uncurt, 4), 'curt' FROM uncurt"""))
def _(spark, sf):
    un, gen = inputs(spark, sf, "uncurt", "gen")
    return rounded(operation.curtailment_iterations(gen, un.withColumnRenamed("MWh uncurt", "MWh")), 4, "MWh")


SEAS = f"f AS MATERIALIZED {facts_sql('tech', 'brand', 'year', 'month', 'a', 'b')}, cp AS (SELECT tech, brand AS region, year, sum(a) / 1e6 AS mw FROM f GROUP BY 1, 2, 3), fm AS (SELECT tech, brand AS region, year, {SEASON} AS season, sum(b) AS firm FROM f WHERE tech <> 'SMALL' AND brand <> 'Brand#3' GROUP BY 1, 2, 3, 4)"


def _seasonal(spark, sf):
    f = rolled(spark, sf, "tech", "brand", "year", "month").withColumnRenamed("brand", "region").withColumn("season", F.expr(SEASON.replace("INTEGER", "INT")))
    cap = f.groupBy("tech", "region", "year").agg((F.sum("a") / 1e6).alias("MW"))
    return cap, f.filter("tech <> 'SMALL' AND region <> 'Brand#3'").groupBy("tech", "region", "year", "season").agg(F.sum("b").alias("firm"))


@query("d24_capacity_credit_iterations", f"""WITH {SEAS} SELECT tech, region, year, s.season, {r('mw', 8)} AS "MW", 'cap' AS type FROM cp CROSS JOIN (SELECT DISTINCT season FROM fm) s WHERE tech IN (SELECT tech FROM fm)
UNION ALL SELECT tech, region, year, season, firm, 'cap_firm' FROM fm""")
def _(spark, sf):
    cap, firm = _seasonal(spark, sf)
    return rounded(operation.capacity_credit_iterations(cap, firm.withColumnRenamed("firm", "MW")), 8, "MW").select("tech", "region", "year", "season", "MW", "type")


@query("d25_capacity_credit_of_new", f"""WITH {SEAS} SELECT c.tech, c.region, c.season, c.year, c.b AS "MW", coalesce(firm, 0) AS "CC Rate" FROM (SELECT tech, brand AS region, {SEASON} AS season, year, sum(b) AS b FROM f GROUP BY 1, 2, 3, 4) c LEFT JOIN fm USING (tech, region, season, year)""")
def _(spark, sf):
    _, firm = _seasonal(spark, sf)
    f = facts(spark, sf, "tech", "brand", "year", "month", "b").withColumn("season", F.expr(SEASON.replace("INTEGER", "INT")))
    cap = f.groupBy("tech", F.col("brand").alias("region"), "season", "year").agg(F.sum("b").alias("MW"))
    return operation.capacity_credit_of_new(cap, firm.withColumnRenamed("firm", "CC Rate"))


RM = "rmap AS (SELECT DISTINCT brand AS rs, concat('p', CAST(substring(brand, 7) AS INTEGER) % 5) AS r FROM f WHERE CAST(substring(brand, 7) AS INTEGER) < 15)"


@query("d26_firm_capacity", f"""WITH {SEAS}, {RM}, ca AS (SELECT tech, coalesce(r, region) AS rb, year, sum(mw) AS mw FROM cp LEFT JOIN rmap ON rs = region GROUP BY 1, 2, 3),
fa AS (SELECT tech, coalesce(r, region) AS rb, year, season, sum(firm) AS firm FROM fm LEFT JOIN rmap ON rs = region GROUP BY 1, 2, 3, 4)
SELECT ca.tech, ca.rb, ca.year, s.season, {r('mw * 1e-3', 11)} AS "Capacity (GW)", {r('coalesce(firm, 0) * 1e-3', 6)} AS "Firm Capacity (GW)", {r('coalesce(firm, 0) / mw')} AS "Capacity Credit"
FROM ca CROSS JOIN (SELECT DISTINCT season FROM fa) s LEFT JOIN fa ON fa.tech = ca.tech AND fa.rb = ca.rb AND fa.year = ca.year AND fa.season = s.season""")
def _(spark, sf):
    cap, firm = _seasonal(spark, sf)
    rmap = inputs(spark, sf, "rmap")
    fa = regions.to_balancing_area(firm, rmap, ["tech", "rb", "year", "season"]).withColumnRenamed("firm", "Firm Capacity (GW)")
    d = operation.firm_capacity(cap.withColumnRenamed("MW", "Capacity (GW)"), fa, rmap, credit=True)
    return rounded(rounded(rounded(d, 11, "Capacity (GW)"), 6, "Firm Capacity (GW)"), 4, "Capacity Credit")


@query("d27_capacity_factor", sql("cap rmap", f"""
, g AS (SELECT tech, status AS vintage, coalesce(r, brand) AS rb, year, sum(b) AS mwh FROM f LEFT JOIN rmap ON rs = brand WHERE tech <> 'SMALL' GROUP BY 1, 2, 3, 4)
SELECT c.tech, c.vintage, c.rb, c.year, {r('mw', 8)} AS "MW", coalesce(mwh, 0) AS "MWh", {r('coalesce(mwh, 0) / (mw * 8760)', 6)} AS "CF" FROM {CAP_RB} c LEFT JOIN g ON g.tech = c.tech AND g.vintage = c.vintage AND g.rb = c.rb AND g.year = c.year""").replace(")\n\n,", "),\n"))
def _(spark, sf):
    cap, rmap = inputs(spark, sf, "cap", "rmap")
    f = facts(spark, sf, "tech", "status", "brand", "year", "b").filter("tech <> 'SMALL'").toDF("tech", "vintage", "region", "year", "MWh")
    gen = regions.to_balancing_area(f, rmap, operation.UNIT)
    return rounded(rounded(operation.capacity_factor(cap, gen, rmap), 6, "CF"), 8, "MW")


@query("d27_hydrogen_capacity_factor", sql("cap rmap", f"""
, c AS (SELECT tech, {AREA} AS rb, year, sum(mw) AS t FROM cap LEFT JOIN rmap ON rs = region GROUP BY 1, 2, 3)
SELECT tech, rb, year, {r('t', 8)} AS "Capacity (tonnes)", {r('CASE WHEN year = 1998 THEN 0 ELSE t * 100 END', 6)} AS "Production (tonnes)", {r('CASE WHEN year = 1998 THEN 0 ELSE t * 100 END / (t * 8760)', 6)} AS "CF" FROM c""").replace(")\n\n,", "),\n"))
def _(spark, sf):
    cap, rmap = inputs(spark, sf, "cap", "rmap")
    cap = cap.withColumnRenamed("MW", "Capacity (tonnes)")
    by = ["tech", "rb", "year"]
    prod = regions.to_balancing_area(cap.drop("vintage"), rmap, by).filter("year <> 1998").withColumn("Production (tonnes)", F.col("Capacity (tonnes)") * 100).drop("Capacity (tonnes)")
    d = operation.capacity_factor(cap, prod, rmap, by, "Capacity (tonnes)", "Production (tonnes)")
    return rounded(rounded(rounded(d, 6, "CF"), 8, "Capacity (tonnes)"), 6, "Production (tonnes)")


@query("d27_capacity_factor_of_new", f"""SELECT tech, brand AS rs, year, sum(b) AS "MWh", {r("sum(CASE WHEN flag = 'A' THEN a END) / 1e6", 8)} AS "MW", {r("sum(b) / (sum(CASE WHEN flag = 'A' THEN a END) / 1e6 * 8760)", 6)} AS "CF" FROM {facts_sql('tech', 'brand', 'year', 'flag', 'a', 'b')} GROUP BY 1, 2, 3 HAVING sum(CASE WHEN flag = 'A' THEN a END) IS NOT NULL""")
def _(spark, sf):
    f = facts(spark, sf, "tech", "brand", "year", "flag", "a", "b").withColumnRenamed("brand", "rs")
    cap = f.filter("flag = 'A'").groupBy("tech", "rs", "year").agg((F.sum("a") / 1e6).alias("MW"))
    return rounded(rounded(operation.capacity_factor_of_new(f.select("tech", "rs", "year", F.col("b").alias("MWh")), cap), 6, "CF"), 8, "MW")


TECHNAME = {"ECONOMY": "wind-ons", "LARGE": "upv", "MEDIUM": "distpv_1", "PROMO": "battery_4", "SMALL": "battery_8", "STANDARD": "coal"}


@query("d28_renewables_and_storage", f"""WITH f AS (SELECT {case('tech', TECHNAME)} AS t, year, flag, b FROM {facts_sql('tech', 'year', 'flag', 'b')}),
y AS (SELECT year, coalesce(sum(CASE WHEN t LIKE 'wind%' THEN b END), 0) / 1e6 AS wind, coalesce(sum(CASE WHEN t LIKE '%upv%' OR t LIKE '%distpv%' THEN b END), 0) / 1e6 AS pv,
 coalesce(sum(CASE WHEN flag = 'A' THEN b END), 0) / 1e6 AS stor, coalesce(sum(CASE WHEN flag = 'A' AND t LIKE 'battery%' THEN b END), 0) / 1e6 AS bat FROM f GROUP BY 1)
SELECT year, {r('wind', 8)} AS "Wind (TWh)", {r('pv', 8)} AS "PV (TWh)", {r('stor', 8)} AS "Storage (TWh)", {r('bat', 8)} AS "Battery (TWh)", {r('wind + pv', 8)} AS "VRE (TWh)" FROM y""")
def _(spark, sf):
    f = facts(spark, sf, "tech", "year", "flag", "b").withColumn("technology", F.expr(case("tech", TECHNAME)))
    gen = f.select("technology", "year", F.col("b").alias("Generation (TWh)"))
    stor = f.select("technology", "year", F.expr("CASE WHEN flag = 'A' THEN 'in' ELSE 'out' END").alias("type"), F.col("b").alias("Storage (TWh)"))
    d = operation.renewables_and_storage(gen, stor)
    return rounded(d, 8, *[c for c in d.columns if c != "year"])


@query("d29_storage_capacity", sql("cap rmap", f"""
, e AS (SELECT tech, coalesce(r, brand) AS rb, year, sum(b) / 1e3 AS gwh FROM f LEFT JOIN rmap ON rs = brand WHERE tech IN ('SMALL', 'PROMO') GROUP BY 1, 2, 3)
SELECT cap.tech, cap.vintage, {AREA} AS rb, cap.year, {r("mw * CASE cap.tech WHEN 'SMALL' THEN 0.5 ELSE 1 END / 1e3", 12)} AS "Capacity (GW)", CASE cap.tech WHEN 'SMALL' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS bcr, {r('gwh', 6)} AS "Energy (GWh)"
FROM cap LEFT JOIN rmap ON rs = region JOIN e ON e.tech = cap.tech AND e.rb = {AREA} AND e.year = cap.year""").replace(")\n\n,", "),\n"))
def _(spark, sf):
    cap, rmap = inputs(spark, sf, "cap", "rmap")
    f = facts(spark, sf, "tech", "brand", "year", "b").filter("tech IN ('SMALL', 'PROMO')").toDF("tech", "region", "year", "Energy (GWh)")
    energy = regions.to_balancing_area(f, rmap)
    bcr = f.filter("tech = 'SMALL'").select("tech").distinct().withColumn("bcr", F.lit(0.5))
    d = operation.storage_capacity(cap.withColumnRenamed("MW", "Capacity (GW)"), bcr, energy, rmap)
    return rounded(rounded(d, 12, "Capacity (GW)"), 6, "Energy (GWh)")


@query("d30_runtime", f"SELECT CAST(CASE WHEN year = 1995 THEN 2000 ELSE year END AS INTEGER) AS year, tech AS process, {r('b / 3600', 6)} AS processtime FROM (SELECT tech, year, sum(b) AS b FROM {facts_sql('tech', 'year', 'b')} GROUP BY 1, 2) WHERE tech <> 'SMALL'")
def _(spark, sf):
    from longview.sources import csvfiles
    f = facts(spark, sf, "tech", "year", "b").groupBy("tech", "year").agg(F.sum("b").alias("b"))
    body = f.select(F.lit(3).alias("row"), F.expr("cast(if(year = 1995, 0, year) as string)").alias("a"), F.col("tech").alias("b1"), F.when(F.col("tech") != "SMALL", F.col("b").cast("string")).alias("c"))
    head = spark.createDataFrame([(0, "git", "x", "y"), (1, "branch", "x", "y"), (2, "year", "process", "processtime")], "row int, a string, b1 string, c string")
    d = operation.runtime(csvfiles.promote_header(head.unionByName(body), 2, "row"))
    return rounded(d, 6, "processtime")


@query("d31_net_emissions", f"SELECT e, tech, year, {r('v / 1e6', 8)} AS \"CO2e (MMton)\", {r('sum(v) OVER (PARTITION BY e, tech ORDER BY year) / 1e6', 8)} AS \"Cumulative CO2e (MMton)\" FROM (SELECT flag AS e, tech, year, sum(b) AS v FROM {facts_sql('flag', 'tech', 'year', 'b')} GROUP BY 1, 2, 3)")
def _(spark, sf):
    f = facts(spark, sf, "flag", "tech", "year", "b").groupBy(F.col("flag").alias("e"), "tech", "year").agg(F.sum("b").alias("CO2e (MMton)"))
    return rounded(operation.net_emissions(f), 8, "CO2e (MMton)", "Cumulative CO2e (MMton)")


HEALTH = f"""h AS (SELECT flag AS model, status AS cr, tech AS e, segment AS rb, year, sum(a) * 1e3 AS dmg, sum(b) AS lives, sum(a) AS em FROM {facts_sql('flag', 'status', 'tech', 'segment', 'year', 'month', 'a', 'b')} WHERE year NOT IN (1997, 1999) AND NOT (tech = 'PROMO' AND segment = 'BUILDING' AND year < 1998) GROUP BY 1, 2, 3, 4, 5),
gr AS (SELECT m.model, c.cr, e.e, b.rb, CAST(y.year AS INTEGER) AS year FROM (SELECT DISTINCT model FROM h) m, (SELECT DISTINCT cr FROM h) c, (SELECT DISTINCT e FROM h) e, (SELECT DISTINCT rb FROM h) b, (SELECT unnest(range(1995, 2002)) AS year) y),
ff AS (SELECT gr.*, last_value(dmg / {DEFL} * 1e-9 IGNORE NULLS) OVER w AS d, last_value(lives IGNORE NULLS) OVER w AS l, last_value(em * 1e-3 IGNORE NULLS) OVER w AS t, last_value(dmg / {DEFL} * 1e-9 / power(1.05, h.year - 2022) IGNORE NULLS) OVER w AS dd
 FROM gr LEFT JOIN h ON h.model = gr.model AND h.cr = gr.cr AND h.e = gr.e AND h.rb = gr.rb AND h.year = gr.year WINDOW w AS (PARTITION BY gr.model, gr.cr, gr.e, gr.rb ORDER BY gr.year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
one AS (SELECT model, cr, e, year, coalesce(sum(t), 0) AS t, coalesce(sum(d), 0) AS d, coalesce(sum(l), 0) AS l, coalesce(sum(dd), 0) AS dd FROM ff GROUP BY 1, 2, 3, 4)"""


@query("d32_health_damage", f"""WITH {HEALTH}
SELECT model, cr, e, year, {r('t', 5)} AS "Emissions (thousand tonnes)", {r('d', 6)} AS "Health damages (billion $)", {r('l', 2)} AS "Health damages (lives)", {r('dd', 6)} AS "Discounted health damages (billion $)",
{r('sum(d) OVER w', 6)} AS "Total health damages (billion $)", {r('sum(l) OVER w', 2)} AS "Total health damages (lives)", {r('sum(dd) OVER w', 6)} AS "Total discounted health damages (billion $)" FROM one WINDOW w AS (PARTITION BY model, cr, year)""")
def _(spark, sf):
    d = operation.health_damage(materialise(spark, inputs(spark, sf, "h")))
    d = rounded(d, 6, *[c for c in d.columns if "billion" in c])
    return rounded(rounded(d, 2, *[c for c in d.columns if "lives" in c]), 5, operation.TONNES)


@query("d33_social_cost", sql("sc types q", f""", {annual_ctes(5, 8, '', True, False)}, {HEALTH},
l AS (SELECT year, sum(q) AS q FROM q WHERE type = 'load' GROUP BY 1), y AS (SELECT CAST(unnest(range(1995, 2010)) AS INTEGER) AS year),
lf AS (SELECT y.year, last_value(q IGNORE NULLS) OVER (ORDER BY y.year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM y LEFT JOIN l ON l.year = y.year),
sy AS (SELECT ann.year, sum(v) AS c, sum(v / power(1.05, ann.year - 2022)) AS dc, avg(q) AS q FROM ann JOIN lf ON lf.year = ann.year GROUP BY 1),
he AS (SELECT year, model, cr, sum(d) AS c, sum(dd) AS dc FROM one GROUP BY 1, 2, 3),
bo AS (SELECT coalesce(sy.year, he.year) AS year, model, cr, q, sy.c AS sc, sy.dc AS sdc, he.c AS hc, he.dc AS hdc FROM sy FULL JOIN he ON he.year = sy.year)
SELECT year, model, cr, q, t.cost_type, {r("CASE t.k WHEN 1 THEN sc ELSE hc END")} AS "Cost (Bil $)", {r("CASE t.k WHEN 1 THEN sdc ELSE hdc END")} AS "Discounted Cost (Bil $)",
{r("CASE t.k WHEN 1 THEN sc ELSE hc END * 1e9 / q", 1)} AS "Average cost ($/MWh)", {r("CASE t.k WHEN 1 THEN sdc ELSE hdc END * 1e9 / q", 1)} AS "Discounted average cost ($/MWh)" FROM bo CROSS JOIN (VALUES (1, 'System cost'), (2, 'System cost + health')) t(k, cost_type)""").replace(")\n,", "),\n"))
def _(spark, sf):
    sc, types, q, h = inputs(spark, sf, "sc", "types", "q", "h")
    system = costs.average_price_national(costs.annualized_cost(sc, types, 5, 8, shift_capital=True), q)
    d = operation.social_cost(system, operation.health_damage(h))
    return rounded(rounded(d, 4, costs.COST, costs.DISCOUNTED), 1, "Average cost ($/MWh)", "Discounted average cost ($/MWh)")


@query("d34_spur_lines", f"""WITH f AS MATERIALIZED {facts_sql('tech', 'flag', 'status', 'segment', 'year', 'a', 'b')},
mi AS (SELECT flag AS trtype, year, sum(b) AS v FROM f WHERE status = 'F' GROUP BY 1, 2), fi AS (SELECT flag AS trtype, year, sum(b) AS v FROM f WHERE status = 'O' AND year > 1996 GROUP BY 1, 2),
tr AS (SELECT trtype, year, mi.v / 1000 AS v, fi.v / 1000 AS w FROM mi FULL JOIN fi USING (trtype, year)),
nb AS (SELECT CASE tech WHEN 'SMALL' THEN 'wind-ons_1' WHEN 'LARGE' THEN 'upv_2' ELSE tech END AS i, segment AS r, flag AS rscbin, year, sum(b) AS mw FROM f WHERE year <> 1998 GROUP BY 1, 2, 3, 4),
ds AS (SELECT CASE tech WHEN 'SMALL' THEN 'wind-ons_1' WHEN 'LARGE' THEN 'upv_2' ELSE tech END AS i, segment AS r, flag AS rscbin, avg(a) / 1000 AS km FROM f GROUP BY 1, 2, 3),
ad AS (SELECT year, sum(mw * km / 1.60934 / 1000) AS v FROM nb LEFT JOIN ds USING (i, r, rscbin) WHERE i LIKE 'wind-ons%' OR i LIKE 'upv%' GROUP BY 1)
SELECT trtype, year, {r('v', 6)} AS "Amount (GW-mi)", {r('w', 6)} AS "Trans cap, PRM (GW-mi)" FROM tr
UNION ALL SELECT 'spur', y.year, {r('sum(coalesce(ad.v, 0)) OVER (ORDER BY y.year)', 6)}, NULL FROM (SELECT DISTINCT year FROM tr) y LEFT JOIN ad ON ad.year = y.year""")
def _(spark, sf):
    f = facts(spark, sf, "tech", "flag", "status", "segment", "year", "a", "b").groupBy("tech", "flag", "status", "segment", "year").agg(
        F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n"))
    f = materialise(spark, f)
    miles = f.filter("status = 'F'").groupBy(F.col("flag").alias("trtype"), "year").agg(F.sum("b").alias("Amount (GW-mi)"))
    firm = f.filter("status = 'O' AND year > 1996").groupBy(F.col("flag").alias("trtype"), "year").agg(F.sum("b").alias("Trans cap, PRM (GW-mi)"))
    named = f.select(F.expr("CASE tech WHEN 'SMALL' THEN 'wind-ons_1' WHEN 'LARGE' THEN 'upv_2' ELSE tech END").alias("i"), F.col("segment").alias("r"), F.col("flag").alias("rscbin"), "year", "a", "b", "n")
    new = named.filter("year <> 1998").select("i", "r", "rscbin", "year", F.col("b").alias("MW"))
    dist = named.groupBy("i", "r", "rscbin").agg((F.sum("a") / F.sum("n") / 1000).alias("dist_km"))
    return rounded(operation.spur_lines(miles, firm, new, dist), 6, "Amount (GW-mi)", "Trans cap, PRM (GW-mi)")


@query("p19_joint_locations", "SELECT p_partkey, p_brand || '-' || p_type AS pair FROM part")
def _(spark, sf):
    return operation.joint_locations(table(spark, sf, "part"), "p_brand", "p_type", "pair").select("p_partkey", "pair")
