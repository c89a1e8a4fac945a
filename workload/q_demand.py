"""Demand pipelines (R) on hourly events and line facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import joins, project, reshape
from longview.plans.demand import devices, hourly, retail
from workload.facts import events, events_sql, facts, facts_sql, materialise, table
from workload.registry import query, r, rounded

# Geography: area = nation, state = market segment of the customer, division = region.
GEO = """geo AS MATERIALIZED (SELECT c_custkey AS county, c_nationkey AS ba, CASE WHEN c_custkey % 7 = 0 THEN 'DC' ELSE concat('S', c_custkey % 3) END AS state, n_regionkey AS div, c_acctbal + 1000 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _geo(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("c_custkey").alias("county"), F.col("c_nationkey").alias("ba"),
                    F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'DC' ELSE concat('S', c_custkey % 3) END").alias("state"),
                    F.col("n_regionkey").alias("div"), (F.col("c_acctbal") + 1000).alias("n"))


SHARES = "sh AS (SELECT ba, CASE state WHEN 'DC' THEN 'MD' ELSE state END AS state, div, sum(n) / sum(sum(n)) OVER (PARTITION BY div) AS share FROM geo GROUP BY 1, 2, 3)"


def _shares(spark, sf):
    g = _geo(spark, sf)
    return hourly.division_shares(g.select("county", "n"), g.drop("n"), "n")


@query("r1_division_shares", f"WITH {GEO}, {SHARES} SELECT ba, state, div, {r('share', 8)} AS share FROM sh")
def _(spark, sf):
    return rounded(_shares(spark, sf), 8, "share")


@query("r1_industrial_shares", f"""WITH f AS MATERIALIZED {facts_sql('segment', 'rb', 'year', 'b', 'status')}, u AS (SELECT segment AS state, year, sum(b) AS v FROM f GROUP BY 1, 2),
g AS (SELECT DISTINCT segment AS state, CASE WHEN segment < 'G' THEN 1 ELSE 2 END AS div FROM f), bs AS (SELECT segment AS state, rb AS ba, sum(b) / sum(sum(b)) OVER (PARTITION BY segment) AS frac FROM f GROUP BY 1, 2),
s AS (SELECT state, div, year, v / sum(v) OVER (PARTITION BY div, year) AS p FROM u JOIN g USING (state)), x AS (SELECT ba, state, div, year, p * frac AS share FROM s JOIN bs USING (state))
SELECT ba, state, div, year, {r('share', 8)} AS share FROM x WHERE year NOT IN (2000, 2001) UNION ALL SELECT ba, state, div, CAST(y AS INTEGER), {r('share', 8)} FROM x CROSS JOIN (VALUES (2000), (2001)) v(y) WHERE year = 1999""")
def _(spark, sf):
    f = facts(spark, sf, "segment", "rb", "year", "b").withColumnRenamed("segment", "state")
    use = f.groupBy("state", "year").agg(F.sum("b").alias("value"))
    geo = f.select("state", F.when(F.col("state") < "G", 1).otherwise(2).alias("div")).distinct()
    from longview.operators import windows
    frac = windows.share(f.groupBy("state", F.col("rb").alias("ba")).agg(F.sum("b").alias("b")), "b", ["state"], "frac").drop("b")
    return rounded(hourly.industrial_shares(use, geo, frac, 1999, [2000, 2001]), 8, "share")


@query("r2_historical_use", f"""SELECT d.div, year, {r('sum(b) * 3412.1416416', 2)} AS value FROM (SELECT scenario, year, b FROM {facts_sql('scenario', 'year', 'b')} ) JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 1), ('5-LOW', 2)) d(n, div) ON n = scenario GROUP BY 1, 2""")
def _(spark, sf):
    f = facts(spark, sf, "scenario", "year", "b")
    names = {"1-URGENT": "Commercial : North.East Contiguous.million kilowatthours", "2-HIGH": "Commercial : South.million kilowatthours", "3-MEDIUM": "Commercial : Mid.West.million kilowatthours",
             "4-NOT SPECIFIED": "Commercial : Islands.million kilowatthours", "5-LOW": "Commercial : West.million kilowatthours"}
    wide = reshape.pivot_first(f.groupBy("year", "scenario").agg(F.sum("b").alias("b")), ["year"], "scenario", "b", list(names)).withColumnsRenamed(names)
    div = f.select(F.expr("CASE scenario WHEN '1-URGENT' THEN 'North East' WHEN '2-HIGH' THEN 'South' WHEN '3-MEDIUM' THEN 'Mid West' WHEN '4-NOT SPECIFIED' THEN 'Islands' WHEN '5-LOW' THEN 'West' END").alias("division"),
                   F.expr("CASE WHEN scenario IN ('1-URGENT', '4-NOT SPECIFIED') THEN 1 ELSE 2 END").alias("div")).distinct().dropna()
    return rounded(hourly.historical_use(wide, div), 2, "value")


@query("r3_own_generation", f"""WITH f AS MATERIALIZED {facts_sql('segment', 'year', 'tech', 'status', 'flag', 'a', 'b')}, u AS (SELECT segment AS div, year, tech AS use, sum(b) AS v FROM f GROUP BY 1, 2, 3),
o AS (SELECT segment AS div, year, sum(CASE WHEN status = 'F' THEN b END) AS solar, sum(CASE WHEN status = 'O' THEN b END) AS other FROM f WHERE flag = 'A' GROUP BY 1, 2)
SELECT u.div, u.year, use, {r("CASE use WHEN 'SMALL' THEN v + 0.35 * solar WHEN 'LARGE' THEN v + other + 0.65 * solar ELSE v END")} AS value FROM u LEFT JOIN o ON o.div = u.div AND o.year = u.year""")
def _(spark, sf):
    f = facts(spark, sf, "segment", "year", "tech", "status", "flag", "b").withColumnRenamed("segment", "div")
    use = f.groupBy("div", "year", F.col("tech").alias("use")).agg(F.sum("b").alias("value"))
    own = f.filter("flag = 'A'").groupBy("div", "year", F.expr("CASE status WHEN 'F' THEN 'solar' ELSE 'other' END").alias("kind")).agg(F.sum("b").alias("amount"))
    parts = [(F.col("use") == "SMALL", {"solar": 0.35}), (F.col("use") == "LARGE", {"solar": 0.65, "other": 1.0})]
    return rounded(hourly.add_own_generation(use, own, ["div", "year"], parts), 4, "value")


@query("r4_backcast", f"""WITH f AS MATERIALIZED {facts_sql('segment', 'year', 'tech', 'a', 'b')}, u AS (SELECT segment AS div, year, tech AS use, sum(b) AS v FROM f WHERE year >= 1998 GROUP BY 1, 2, 3),
t AS (SELECT segment AS div, year, sum(a) / 1e3 AS v FROM f WHERE year < 1998 GROUP BY 1, 2), s AS (SELECT div, use, v / sum(v) OVER (PARTITION BY div) AS p FROM u WHERE year = 1998)
SELECT div, year, use, {r('v')} AS value FROM u UNION ALL SELECT t.div, t.year, use, {r('t.v * p')} FROM t JOIN s ON s.div = t.div WHERE year IN (1996, 1997)""")
def _(spark, sf):
    f = facts(spark, sf, "segment", "year", "tech", "a", "b").withColumnRenamed("segment", "div")
    use = f.filter("year >= 1998").groupBy("div", "year", F.col("tech").alias("use")).agg(F.sum("b").alias("value"))
    totals = f.filter("year < 1998").groupBy("div", "year").agg((F.sum("a") / 1e3).alias("value"))
    return rounded(hourly.backcast(use, totals, 1998, [1996, 1997]), 4, "value")


# Hourly demand: shapes from events by hour of the month, consumption from the line facts.
USES = ["click", "view", "purchase"]
EVENT_USE = "CASE WHEN tech IN ('click', 'view') THEN tech ELSE 'purchase' END"  # every event type has a use
SHAPES = f"""ev AS MATERIALIZED {events_sql('user', 'hoy', 'tech', 'value')},
shp AS (SELECT concat('S', user % 3) AS state, hoy AS hour, {', '.join(f"sum(CASE WHEN {EVENT_USE} = '{u}' THEN value ELSE 0 END) / 1e4 AS {u}" for u in USES)} FROM ev GROUP BY 1, 2)"""
USE = f"""us AS MATERIALIZED (SELECT n_regionkey AS div, year, CASE flag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'purchase' END AS use, sum(b) AS v FROM {facts_sql('rb', 'year', 'flag', 'b')} JOIN nation ON n_name = rb GROUP BY 1, 2, 3)"""
AREA = f"ar AS MATERIALIZED (SELECT sh.ba, sh.div, hour, u.use, CASE u.use WHEN 'click' THEN click WHEN 'view' THEN view ELSE purchase END * share AS x FROM shp JOIN sh ON sh.state = shp.state CROSS JOIN (VALUES ('click'), ('view'), ('purchase')) u(use))"
PROFILE = "pr AS MATERIALIZED (SELECT ba, year, hour, sum(v * x) AS value FROM ar JOIN us ON us.div = ar.div AND us.use = ar.use GROUP BY 1, 2, 3)"
TMAP = "tm AS (SELECT DISTINCT hoy AS hour, CASE WHEN hoy % 24 BETWEEN 12 AND 17 THEN 'H3' WHEN hoy % 24 < 12 THEN 'H1' ELSE 'H2' END AS slice FROM ev)"
PEAK = "pk AS (SELECT ba, year, hour FROM (SELECT *, row_number() OVER (PARTITION BY ba, year ORDER BY value DESC, hour) AS n FROM pr JOIN tm USING (hour) WHERE slice = 'H3') WHERE n <= 40)"


def _shapes(spark, sf):
    e = events(spark, sf, "user", "hoy", "tech", "value")
    return e.groupBy(F.expr("concat('S', user % 3)").alias("state"), F.col("hoy").alias("hour")).agg(
        *[(F.sum(F.when(F.expr(EVENT_USE) == u, F.col("value")).otherwise(0)) / 1e4).alias(u) for u in USES])


def _use(spark, sf):
    f = facts(spark, sf, "rb", "year", "flag", "b").join(table(spark, sf, "nation"), F.col("rb") == F.col("n_name"))
    return f.groupBy(F.col("n_regionkey").alias("div"), "year", F.expr("CASE flag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'purchase' END").alias("use")).agg(F.sum("b").alias("value"))


def _profile(spark, sf):
    return hourly.hourly_profile(_use(spark, sf), hourly.area_shapes(_shapes(spark, sf), _shares(spark, sf), USES))


def _time_map(spark, sf):
    return events(spark, sf, "hoy").distinct().select(F.col("hoy").alias("hour"), F.expr("CASE WHEN hoy % 24 BETWEEN 12 AND 17 THEN 'H3' WHEN hoy % 24 < 12 THEN 'H1' ELSE 'H2' END").alias("slice"))


BASE = f"WITH {GEO}, {SHARES}, {SHAPES}, {USE}, {AREA}, {PROFILE}, {TMAP}"


@query("r5_hourly_profile", f"{BASE} SELECT ba, year, hour, {r('value')} AS value FROM pr")
def _(spark, sf):
    return rounded(_profile(spark, sf), 4, "value")


@query("r5_industrial_profile", f"""WITH ev AS {events_sql('rb', 'hoy', 'value')}, x AS (SELECT CAST(rb AS INTEGER) AS ba, hoy AS hour, CAST(rb AS INTEGER) % 2 AS div, sum(value) / 1e4 AS p FROM ev GROUP BY 1, 2),
u AS (SELECT line % 2 AS div, year, sum(b) AS v FROM {facts_sql('line', 'year', 'b')} GROUP BY 1, 2), s AS (SELECT ba, div, hour, y.year, p * (1 + (y.year - 1995) * 0.1) AS x FROM x CROSS JOIN (SELECT DISTINCT year FROM u) y)
SELECT ba, s.year, hour, {r('x * v', 8)} AS value FROM s JOIN u ON u.div = s.div AND u.year = s.year""")
def _(spark, sf):
    e = events(spark, sf, "rb", "hoy", "value").groupBy(F.col("rb").cast("int").alias("ba"), F.col("hoy").alias("hour")).agg((F.sum("value") / 1e4).alias("p"))
    use = facts(spark, sf, "line", "year", "b").groupBy((F.col("line") % 2).alias("div"), "year").agg(F.sum("b").alias("value"))
    shapes = joins.expand_by(e.withColumn("div", F.col("ba") % 2), use.select("year").distinct())
    shapes = shapes.withColumn("shape", F.col("p") * (1 + (F.col("year") - 1995) * 0.1))
    return rounded(hourly.hourly_profile(use, shapes), 8, "value")


@query("r6_sector_total", f"""{BASE}, own AS (SELECT ba, year, hour, value AS v1 FROM pr),
other AS (SELECT CAST(rb AS INTEGER) AS ba, hoy AS hour, sum(value) AS v2 FROM {events_sql('rb', 'hoy', 'value')} GROUP BY 1, 2)
SELECT own.ba, own.year, own.hour, {r('v1 + v2 * 0.5 + 1')} AS value FROM own JOIN other ON other.ba = own.ba AND other.hour = own.hour""")
def _(spark, sf):
    p = _profile(spark, sf)
    e = events(spark, sf, "rb", "hoy", "value").groupBy(F.col("rb").cast("int").alias("ba"), F.col("hoy").alias("hour")).agg((F.sum("value") * 0.5 + 1).alias("value"))
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return rounded(hourly.sector_total(p, joins.expand_by(e, years)), 4, "value")


@query("r7_peak_hours", f"{BASE}, {PEAK} SELECT * FROM pk")
def _(spark, sf):
    return hourly.peak_hours(rounded(_profile(spark, sf), 9, "value"), _time_map(spark, sf))


@query("r8_time_map", f"""{BASE}, {PEAK}, m AS (SELECT a.ba, CAST(y.year AS INTEGER) AS year, tm.hour, CASE WHEN pk.ba IS NOT NULL THEN 'H17' ELSE slice END AS slice FROM (SELECT DISTINCT ba FROM pr) a CROSS JOIN (VALUES (1998), (1999), (2000), (2001)) y(year) CROSS JOIN tm
 LEFT JOIN pk ON pk.ba = a.ba AND pk.year = y.year AND pk.hour = tm.hour)
SELECT * FROM m UNION ALL SELECT ba, CAST(y AS INTEGER), hour, slice FROM m CROSS JOIN (VALUES (1995), (1996), (1997)) v(y) WHERE year = 1998""")
def _(spark, sf):
    p, tm = materialise(spark, rounded(_profile(spark, sf), 9, "value")), _time_map(spark, sf)
    return hourly.time_map_by_area(tm, p, hourly.peak_hours(p, tm), [1998, 1999, 2000, 2001], 1998, [1995, 1996, 1997])


@query("r9_slice_energy", f"""{BASE}, {PEAK} SELECT concat('p', pr.ba) AS ba, pr.year, CASE WHEN pk.ba IS NOT NULL THEN 'H17' ELSE slice END AS slice, {r('sum(value) * 0.29329722222222')} AS value
FROM pr JOIN tm USING (hour) LEFT JOIN pk ON pk.ba = pr.ba AND pk.year = pr.year AND pk.hour = pr.hour GROUP BY 1, 2, 3""")
def _(spark, sf):
    p, tm = materialise(spark, rounded(_profile(spark, sf), 9, "value")), _time_map(spark, sf)
    d = hourly.relabel_peak(joins.natural_join(p, tm), hourly.peak_hours(p, tm))
    return rounded(hourly.slice_energy(d), 4, "value")


@query("r10_slice_shapes", f"""WITH {GEO}, {SHAPES}, {TMAP} SELECT g.ba, g.div, slice, u.use, {r("sum(CASE u.use WHEN 'click' THEN click WHEN 'view' THEN view ELSE purchase END)", 6)} AS shape
FROM shp JOIN (SELECT DISTINCT state, ba, div FROM geo) g USING (state) JOIN tm USING (hour) CROSS JOIN (VALUES ('click'), ('view'), ('purchase')) u(use) GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return rounded(hourly.slice_shapes(_shapes(spark, sf), _geo(spark, sf), _time_map(spark, sf), USES), 6, "shape")


# Devices: division = region of the customer, device = part type, use = order priority code.
DEV = f"dv AS MATERIALIZED (SELECT n_regionkey AS div, year, tech AS device, CASE substring(scenario, 1, 1) WHEN '1' THEN 'MSC' WHEN '2' THEN 'FUF' ELSE 'HT' END AS use, b, c, a FROM {facts_sql('rb', 'year', 'tech', 'scenario', 'a', 'b', 'c')} JOIN nation ON n_name = rb)"
ASH = "ash AS (SELECT ba, div, sum(share) AS share FROM sh GROUP BY 1, 2)"


def _devices(spark, sf):
    f = facts(spark, sf, "rb", "year", "tech", "scenario", "a", "b", "c").join(table(spark, sf, "nation"), F.col("rb") == F.col("n_name"))
    return f.select(F.col("n_regionkey").alias("div"), "year", F.col("tech").alias("device"),
                    F.expr("CASE substring(scenario, 1, 1) WHEN '1' THEN 'MSC' WHEN '2' THEN 'FUF' ELSE 'HT' END").alias("use"), "a", "b", "c")


def _area_shares(spark, sf):
    return _shares(spark, sf).groupBy("ba", "div").agg(F.sum("share").alias("share"))


def _weibull(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_type").alias("device")).agg(F.avg("p_size").alias("life"))
    return p.select("device", (F.col("life") / 2).alias("scale"), F.lit(1.5).alias("shape"))


WB = "wb AS (SELECT p_type AS device, avg(p_size) / 2 AS scale, 1.5 AS shape FROM part GROUP BY 1)"


@query("r11_base_stock_retirement", f"""WITH {GEO}, {SHARES}, {ASH}, {DEV}, {WB}, st AS (SELECT div, device, use, sum(b) AS total FROM dv WHERE year = 1995 GROUP BY 1, 2, 3),
rt AS (SELECT device, CAST(y AS INTEGER) AS year, 1 - exp(-power((y - 1995) / scale, shape)) AS gone FROM wb CROSS JOIN (SELECT unnest(range(1996, 2011)) AS y)),
l AS (SELECT div, year, use, device, sum(total * (1 - gone)) AS v FROM st JOIN rt USING (device) GROUP BY 1, 2, 3, 4)
SELECT concat('p', ba) AS ba, year, use, device, {r('v * share', 3)} AS "left" FROM l JOIN ash USING (div)""")
def _(spark, sf):
    d = _devices(spark, sf)
    stock = d.filter("year = 1995").groupBy("div", "device", "use").agg(F.sum("b").alias("total"))
    gone = devices.retirement(_weibull(spark, sf), 1996, 2010).select("device", "year", "retired")
    return rounded(devices.remaining_stock(stock, gone, _area_shares(spark, sf), ["use", "device"]), 3, "left")


@query("r12_total_devices", f"""WITH {GEO}, {SHARES}, {ASH}, {DEV}, t AS (SELECT div, year, use, device, sum(b) AS v FROM dv GROUP BY 1, 2, 3, 4)
SELECT concat('p', ba) AS ba, year, use, device, {r("CASE WHEN use IN ('MSC', 'FUF', 'SCH') THEN 1 ELSE v * share END", 3)} AS total FROM t JOIN ash USING (div)""")
def _(spark, sf):
    d = _devices(spark, sf).withColumnRenamed("b", "total")
    return rounded(devices.total_devices(d, _area_shares(spark, sf), ["use", "device"]), 3, "total")


UNITS = {"ECONOMY": "btu", "LARGE": "cycles", "MEDIUM": "generic", "PROMO": "btu", "SMALL": "lumens", "STANDARD": "btu"}
UNIT_SQL = "CASE device " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNITS.items()) + " END"
SERVICE = f"""u AS (SELECT div, year, use, device, {UNIT_SQL} AS serv_units, sum(b) AS energy FROM dv GROUP BY 1, 2, 3, 4),
av AS (SELECT year, device, avg(c) AS e FROM dv WHERE year > 1995 AND year <> 2000 GROUP BY 1, 2), bs AS (SELECT device, avg(c) * 1.1 AS e FROM dv WHERE year = 1995 GROUP BY 1),
sv AS (SELECT u.*, energy * CASE WHEN use IN ('FF', 'SH', 'FUF') THEN 1 WHEN serv_units IN ('cycles', 'generic') THEN CASE WHEN u.year > 1995 THEN bs.e / av.e ELSE 1 END WHEN u.year > 1995 THEN av.e ELSE bs.e END AS service
 FROM u LEFT JOIN av ON av.year = u.year AND av.device = u.device LEFT JOIN bs ON bs.device = u.device)"""


def _service(spark, sf):
    d = _devices(spark, sf)
    use = d.groupBy("div", "year", "use", "device", F.expr(UNIT_SQL).alias("serv_units")).agg(F.sum("b").alias("energy"))
    avg = d.filter("year > 1995 AND year <> 2000").groupBy("year", "device").agg(F.avg("c").alias("avg_eff"))
    base = d.filter("year = 1995").groupBy("device").agg((F.avg("c") * 1.1).alias("base_eff"))
    return devices.service_demand(use, avg, base, 1995, plain=("FF", "SH", "FUF"))


@query("r13_service_demand", f"WITH {DEV}, {SERVICE} SELECT div, year, use, device, energy, {r('service')} AS service FROM sv")
def _(spark, sf):
    return rounded(_service(spark, sf).select("div", "year", "use", "device", "energy", "service"), 4, "service")


@query("r13_reference_efficiency", f"WITH {DEV}, {SERVICE} SELECT div, year, use, {r('coalesce(sum(service) / sum(energy), 1)', 8)} AS ref_eff FROM sv WHERE year > 1995 GROUP BY 1, 2, 3")
def _(spark, sf):
    d = devices.reference_efficiency(_service(spark, sf), ["use"], 1995)
    return rounded(d.select("div", "year", "use", "ref_eff"), 8, "ref_eff")


OPT = f"""op AS MATERIALIZED (SELECT p_partkey AS opt, p_brand AS device_name, p_partkey % 5 AS div, nullif(p_type, 'PROMO') AS device, CASE WHEN p_size % 4 = 0 THEN 'NG' ELSE 'EL' END AS fuel, CASE WHEN p_size % 3 = 0 THEN 'cycles' ELSE 'btu' END AS serv_units,
 p_retailprice AS eff, 1000.0::DOUBLE AS base_eff, CAST(2005 + p_size % 20 AS INTEGER) AS first_year, CAST(2012 + p_size % 17 AS INTEGER) AS last_year, 1 + p_size / 10.0 AS shape, 5.0::DOUBLE AS scale FROM part)"""


def _options(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("opt"), (F.col("p_partkey") % 5).cast("int").alias("div"), F.expr("nullif(p_type, 'PROMO')").alias("device"),
        F.expr("CASE WHEN p_size % 4 = 0 THEN 'NG' ELSE 'EL' END").alias("fuel"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'cycles' ELSE 'btu' END").alias("serv_units"),
        F.col("p_retailprice").alias("eff"), F.lit(1000.0).alias("base_eff"), (2005 + F.col("p_size") % 20).alias("first_year"), (2012 + F.col("p_size") % 17).alias("last_year"),
        (1 + F.col("p_size") / 10).alias("shape"), F.lit(5.0).alias("scale"))


@query("r14_technology_options", f"""WITH {GEO}, {OPT}, ex AS (SELECT *, CAST(unnest(range(greatest(first_year, 2010), least(last_year, 2020) + 1)) AS INTEGER) AS year FROM op WHERE fuel = 'EL' AND device IS NOT NULL)
SELECT opt, ba, year, {r("CASE serv_units WHEN 'cycles' THEN base_eff / eff ELSE eff END", 6)} AS eff FROM ex JOIN (SELECT DISTINCT div, ba FROM geo) USING (div)""")
def _(spark, sf):
    d = devices.technology_options(_options(spark, sf), _geo(spark, sf), 2010, 2020)
    return rounded(d.select("opt", "ba", "year", "eff"), 6, "eff")


@query("r15_survival_rates", f"""WITH {OPT}, ex AS (SELECT *, CAST(unnest(range(2010, year + 1)) AS INTEGER) AS vintage FROM (SELECT *, CAST(unnest(range(greatest(first_year, 2010), least(last_year, 2020) + 1)) AS INTEGER) AS year FROM op)),
s AS (SELECT opt, year, vintage, exp(-power((year - vintage) / scale, shape)) AS v FROM ex)
SELECT opt, year, vintage, {r('CASE WHEN v < 0.001 THEN 0 ELSE v END', 8)} AS survival FROM s""")
def _(spark, sf):
    d = joins.within_years(_options(spark, sf), "first_year", "last_year", 2010, 2020)
    return rounded(devices.survival_rates(d, 2010).select("opt", "year", "vintage", "survival"), 8, "survival")


@query("r16_unit_conversion", f"""WITH {DEV} SELECT div, year, use, device, {r(f"CASE {UNIT_SQL} WHEN 'lumens' THEN sum(b) / (3.41214 * 8760) WHEN 'cycles' THEN sum(b) * 1e3 * 3.41214 WHEN 'generic' THEN sum(b) * 1e3 * 3.41214 ELSE sum(b) END")} AS eff FROM dv GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    d = _devices(spark, sf).groupBy("div", "year", "use", "device").agg(F.sum("b").alias("eff")).withColumn("unit", F.expr(UNIT_SQL))
    return rounded(devices.convert_units(d, "eff", "unit", devices.SERVICE_UNITS).drop("unit"), 4, "eff")


@query("r17_retail_prices", f"""WITH f AS MATERIALIZED {facts_sql('rb', 'segment', 'flag', 'year', 'a', 'b', 'c')},
pr AS (SELECT segment AS state, avg(CASE WHEN flag = 'A' THEN a / b END) AS res, avg(CASE WHEN flag = 'N' THEN a / b END) AS com, avg(CASE WHEN flag = 'R' THEN a / b END) AS ind, sum(CASE WHEN flag = 'A' THEN b END) AS rq, sum(CASE WHEN flag = 'N' THEN b END) AS cq, sum(CASE WHEN flag = 'R' THEN b END) AS iq FROM f GROUP BY 1),
ov AS (SELECT rb AS ba, segment AS market, sum(b) AS area FROM f GROUP BY 1, 2), mk AS (SELECT ba, market FROM (SELECT *, rank() OVER (PARTITION BY ba ORDER BY area DESC) AS k FROM ov) WHERE k = 1),
ad AS (SELECT segment AS market, sum(c) AS x FROM (SELECT segment, flag, avg(c) AS c FROM f WHERE year = 1998 GROUP BY 1, 2) GROUP BY 1), geo AS (SELECT DISTINCT rb AS ba, segment AS state FROM f),
j AS (SELECT ba, res, com, ind, (res * rq + com * cq + ind * iq) / (x * (rq + cq + iq)) AS gen FROM pr JOIN geo USING (state) JOIN mk USING (ba) JOIN ad USING (market))
SELECT s.sector, ba, {r("10 * CASE s.sector WHEN 'res' THEN res WHEN 'com' THEN com ELSE ind END")} AS price, {r("10 * (CASE s.sector WHEN 'res' THEN res WHEN 'com' THEN com ELSE ind END - gen)")} AS adder FROM j CROSS JOIN (VALUES ('res'), ('com'), ('ind')) s(sector)""")
def _(spark, sf):
    f = facts(spark, sf, "rb", "segment", "flag", "year", "a", "b", "c")
    def pick(v, x):
        return F.when(F.col("flag") == v, x)
    unit = F.col("a") / F.col("b")
    kinds = {"A": "res", "N": "com", "R": "ind"}
    prices = f.groupBy(F.col("segment").alias("state")).agg(*[F.avg(pick(k, unit)).alias(n) for k, n in kinds.items()])
    sales = f.groupBy(F.col("segment").alias("state")).agg(*[F.sum(pick(k, F.col("b"))).alias(f"{n}_sales") for k, n in kinds.items()])
    overlap = f.groupBy(F.col("rb").alias("ba"), F.col("segment").alias("market")).agg(F.sum("b").alias("area"))
    adders = f.groupBy(F.col("segment").alias("market"), F.col("flag").alias("category"), "year").agg(F.avg("c").alias("adder"))
    geo = f.select(F.col("rb").alias("ba"), F.col("segment").alias("state")).distinct()
    return rounded(retail.retail_prices(prices, sales, geo, retail.market_of_area(overlap), adders, 1998), 4, "price", "adder")


PURCHASE_SQL = f"""WITH RECURSIVE {DEV.replace(' AS MATERIALIZED', ' AS')}, {WB}, st AS MATERIALIZED (SELECT device, year, sum(b) AS stock FROM dv GROUP BY 1, 2),
rec AS (SELECT device, 1995 AS year, [CAST(stock AS DOUBLE)] AS p FROM st WHERE year = 1995
 UNION ALL SELECT rec.device, rec.year + 1, list_append(p, st.stock - list_sum([p[i] * CASE WHEN exp(-power((rec.year + 1 - (1994 + i)) / scale, shape)) < 0.001 THEN 0 ELSE exp(-power((rec.year + 1 - (1994 + i)) / scale, shape)) END FOR i IN range(1, len(p) + 1)]))
 FROM rec JOIN st ON st.device = rec.device AND st.year = rec.year + 1 JOIN wb ON wb.device = rec.device)
SELECT device, CAST(year AS INTEGER) AS year, {r('p[len(p)]')} AS purchases FROM rec"""


@query("r18_new_purchases", PURCHASE_SQL)
def _(spark, sf):
    stock = _devices(spark, sf).groupBy("device", "year").agg(F.sum("b").alias("stock")).join(_weibull(spark, sf), "device")
    return rounded(devices.new_purchases(stock, ["device"]), 4, "purchases")


@query("r19_compare_sources", f"""WITH f AS MATERIALIZED {facts_sql('segment', 'year', 'flag', 'status', 'b', 'c')}, t AS (SELECT year, segment, sum(b) AS x, coalesce(sum(CASE WHEN NOT (flag = 'A' AND status = 'F') THEN b END), 0) AS y, sum(b * c) AS z FROM f GROUP BY 1, 2)
SELECT year, segment, 'all' AS source, {r('x')} AS value FROM t UNION ALL SELECT year, segment, 'without', {r('y')} FROM t UNION ALL SELECT year, segment, 'published', {r('z')} FROM t WHERE true""")
def _(spark, sf):
    f = facts(spark, sf, "segment", "year", "flag", "status", "b", "c")
    published = f.groupBy("year", "segment").agg(F.sum(F.col("b") * F.col("c")).alias("published"))
    out = retail.compare_sources(f.withColumnRenamed("b", "value"), published, "segment", (F.col("flag") == "A") & (F.col("status") == "F"),
                                 {"all_rows": "all", "without_excluded": "without"})
    return rounded(out, 4, "value")
