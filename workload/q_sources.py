"""Sources (S), column mapper (M) and sinks (K) over CSV trees written from the test tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from longview.operators import aggregate as agg
from longview.operators import project, reshape
from longview.plans import report
from longview.plans.view import ViewSpec, run_view
from longview.shared import hadoop_path
from longview.sources import catalog, csvfiles, mapping, scenarios, sinks
from longview.sources.listing import files_below, with_headers
from workload.facts import events, events_sql, facts, facts_sql, scratch, table
from workload.registry import query, r, rounded

_AREAS: dict[tuple[str, str], str] = {}
HOURLY = f"(SELECT scenario, tech, year, month, day, hour, {r('sum(value)', 2)} AS value FROM {events_sql('scenario', 'tech', 'year', 'month', 'day', 'hour', 'value')} GROUP BY 1, 2, 3, 4, 5, 6)"
LINE = "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double"
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # all part types
WEEKS = ["w1", "w2", "w3", "w4", "w5"]  # all weeks of the events
LINE_COLS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]


def area(spark, sf) -> str:
    """CSV trees of this session: runs, raw inputs, tables with preamble or no header."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _AREAS:
        return _AREAS[key]
    root = scratch(spark)
    d = events(spark, sf, "scenario", "tech", "year", "month", "day", "hour", "value")
    hourly = rounded(agg.sum_over(d, ["scenario", "tech", "year", "month", "day", "hour"], val_cols=["value"]), 2, "value")
    names = [x[0] for x in d.select("scenario").distinct().orderBy("scenario").collect()]
    for s in names:
        one = hourly.filter(F.col("scenario") == s).drop("scenario")
        text = one.withColumn("value", F.when(F.col("value") < 5, F.lit("Eps")).otherwise(F.col("value").cast("string")))
        sinks.write_csv(text.withColumn("tech", F.upper("tech")), f"{root}/runs/{s}/outputs/gen.csv")
        sinks.write_csv(one.toDF("category_name", "year", "month", "day", "Hour", "Generation"), f"{root}/inputs/{s}/raw.csv")
        sinks.write_csv(one.groupBy("tech").agg(F.sum("value").alias("total")), f"{root}/runs/{s}/outputs/total.csv", header=False)
        if s != names[-1]:
            sinks.write_marker(spark, f"{root}/runs/{s}/outputs/BP.csv")
    li = table(spark, sf, "lineitem")
    sinks.write_csv(li.select(*LINE_COLS), f"{root}/flat/lineitem")
    sinks.write_csv(li.filter("l_linenumber > 3").select("l_orderkey", "l_linenumber", "l_tax"), f"{root}/flat/tax")
    _AREAS[key] = root
    return root


def put_files(spark, df, folder: str) -> str:
    """The rows of each name as ``<folder>/<name>.csv``, further part files with a number behind the name."""
    staged = scratch(spark)
    df.write.partitionBy("name").option("header", True).csv(staged)
    fs, path = hadoop_path(spark, staged)
    _, to = hadoop_path(spark, folder)
    fs.mkdirs(to)
    for part in fs.listStatus(path):
        name = part.getPath().getName()
        if name.startswith("name="):
            files = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            for i, f in enumerate(files):
                assert fs.rename(f, hadoop_path(spark, f"{folder}/{name.removeprefix('name=')}{i or ''}.csv")[1])
    return folder


def by_file(spark, sf) -> str:
    """A folder with one sorted CSV file a run."""
    key = (spark.sparkContext.applicationId, sf, "files")
    if key not in _AREAS:
        root = area(spark, sf)
        d = spark.read.option("header", True).option("inferSchema", True).csv([f"{root}/inputs/{s}/raw.csv" for s in WEEKS])
        d = d.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), "/(w[0-9])/raw", 1))
        d = d.select("name", "category_name", "year", "month", "day", "Hour", "Generation")
        d = d.repartition("name").sortWithinPartitions("name", "category_name", "month", "day", "Hour")  # the hours of a week at most
        _AREAS[key] = put_files(spark, d, f"{scratch(spark)}/files")
    return _AREAS[key]


# ---- sources -------------------------------------------------------------------------

@query("s1_csv_scan", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def _(spark, sf):
    return csvfiles.read_csv_source(spark, f"{area(spark, sf)}/flat/lineitem", LINE).drop("filename")


@query("s1_csv_scan_inferred", "SELECT l_returnflag, sum(l_quantity) AS q, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    d = csvfiles.read_csv_source(spark, f"{area(spark, sf)}/flat/lineitem")
    return d.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").alias("n"))


@query("s2_csv_directory", f"SELECT scenario AS filename, tech AS category_name, year, month, day, hour AS \"Hour\", value AS \"Generation\" FROM {HOURLY}")
def _(spark, sf):
    """One file a run, united with the name of its file."""
    d = csvfiles.read_csv_source(spark, by_file(spark, sf))
    return d.select("filename", "category_name", "year", "month", "day", "Hour", "Generation")


@query("s2_mixed_headers", f"""
SELECT 'lineitem' AS kind, CAST(NULL AS VARCHAR) AS category_name, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem
UNION ALL SELECT 'week', tech, count(*), NULL FROM {HOURLY} GROUP BY 2""")
def _(spark, sf):
    """A folder whose files have different headers: a scan for each, whatever the number of files."""
    out = f"{scratch(spark)}/mixed"
    put_files(spark, table(spark, sf, "lineitem").select(F.lit("lineitem").alias("name"), *LINE_COLS), out)
    put_files(spark, spark.read.option("header", True).csv(by_file(spark, sf)).select(F.substring(F.input_file_name(), -6, 2).alias("name"), "*"), out)
    d = csvfiles.read_csv_source(spark, out)
    kind = F.when(F.col("filename").startswith("lineitem"), "lineitem").otherwise("week")
    d = d.groupBy(kind.alias("kind"), "category_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))
    return d


@query("s3_several_sources", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, NULL AS l_tax FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, l_tax FROM lineitem WHERE l_linenumber > 3""")
def _(spark, sf):
    root = area(spark, sf)
    d = csvfiles.read_csv_source(spark, f"{root}/flat/lineitem | {root}/flat/tax")
    return d.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax").withColumns(
        {"l_orderkey": F.col("l_orderkey").cast("long"), "l_quantity": F.col("l_quantity").cast("double")})


@query("s4_scenario_discovery", "SELECT scenario AS name, true AS marked FROM (SELECT DISTINCT scenario FROM " + events_sql("scenario") + ") WHERE scenario <> 'w5'")
def _(spark, sf):
    found = scenarios.discover_scenarios(spark, f"{area(spark, sf)}/runs")
    return spark.createDataFrame([(s.name, s.path.endswith(f"/runs/{s.name}")) for s in found], "name string, marked boolean")


@query("s5_scenario_list", f"SELECT scenario, color, {r('sum(CASE WHEN value < 5 THEN 0 ELSE value END)', 2)} AS value FROM {HOURLY} JOIN (VALUES ('w2', '#1f77b4'), ('w1', '#ff7f0e')) v(name, color) ON name = scenario GROUP BY 1, 2")
def _(spark, sf):
    root = area(spark, sf)
    listing = f"{scratch(spark)}/scenarios.csv"
    rows = [("w2", "#1f77b4", f"{root}/runs/w2"), ("w1", "#ff7f0e", f"{root}/runs/w1"), ("gone", "#2ca02c", f"{root}/runs/gone")]
    sinks.write_csv(spark.createDataFrame(rows, "name string, color string, path string").coalesce(1), listing)
    found = scenarios.discover_scenarios(spark, listing)
    tint = F.create_map(*[F.lit(v) for s in found for v in (s.name, s.color)])
    d = scenarios.read_source(spark, found, {"file": "gen.csv"})
    d = d.groupBy("scenario").agg(F.sum("value").alias("value")).withColumn("color", F.try_element_at(tint, F.col("scenario")))
    return rounded(d, 2, "value")


@query("s6_headerless_source", f"SELECT scenario, technology, {r('total', 2)} AS amount FROM (SELECT scenario, tech AS technology, sum(value) AS total FROM {HOURLY} WHERE scenario <> 'w5' GROUP BY 1, 2)")
def _(spark, sf):
    found = scenarios.discover_scenarios(spark, f"{area(spark, sf)}/runs")
    d = scenarios.read_source(spark, found, {"file": "total.csv", "header": None, "columns": ["technology", "amount"]})
    return rounded(d, 2, "amount")


@query("s7_transpose", f"""
SELECT measure, {', '.join(f"{r(f'sum(CASE WHEN flag = {chr(39)}{v}{chr(39)} THEN v END)', 2)} AS {v}" for v in 'ANR')} FROM
(SELECT flag, 'a' AS measure, sum(a) AS v FROM {facts_sql('flag', 'a')} GROUP BY 1 UNION ALL SELECT flag, 'b', sum(b) FROM {facts_sql('flag', 'b')} GROUP BY 1) GROUP BY 1""")
def _(spark, sf):
    d = rounded(agg.sum_over(facts(spark, sf, "flag", "a", "b"), ["flag"], val_cols=["a", "b"]), 2, "a", "b")
    return reshape.transpose(d, "flag").withColumnRenamed("key", "measure")


@query("s8_sentinel_clean", f"SELECT scenario, tech, year, month, day, hour, CASE WHEN value < 5 THEN 0 ELSE value END AS value FROM {HOURLY} WHERE scenario <> 'w5'")
def _(spark, sf):
    found = scenarios.discover_scenarios(spark, f"{area(spark, sf)}/runs")
    return scenarios.read_source(spark, found, {"file": "gen.csv"}).withColumn("value", F.col("value").cast("double"))


@query("s9_lowercase", "SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS l_returnflag, l_quantity FROM lineitem")
def _(spark, sf):
    return project.lowercase_strings(csvfiles.read_csv_source(spark, f"{area(spark, sf)}/flat/lineitem", LINE).drop("filename"))


def _catalog(spark, sf):
    return catalog.build_catalog(spark, f"{area(spark, sf)}/runs")


@query("s10_scenario_union", f"""
WITH g AS (SELECT scenario, tech, year, month, day, sum(CASE WHEN value < 5 THEN 0 ELSE value END) AS value FROM {HOURLY} WHERE scenario IN ('w2', 'w3') GROUP BY 1, 2, 3, 4, 5)
SELECT s.scenario, t.tech, y.year, m.month, d.day, {r('coalesce(g.value, 0)', 2)} AS value FROM (SELECT DISTINCT scenario FROM g) s, (SELECT DISTINCT tech FROM g) t, (SELECT DISTINCT year FROM g) y,
(SELECT DISTINCT month FROM g) m, (SELECT DISTINCT day FROM g) d LEFT JOIN g ON g.scenario = s.scenario AND g.tech = t.tech AND g.year = y.year AND g.month = m.month AND g.day = d.day""")
def _(spark, sf):
    found = {s.name: s for s in scenarios.discover_scenarios(spark, f"{area(spark, sf)}/runs")}
    store = scenarios.ResultStore(spark, _catalog(spark, sf))
    store.load("value (Daily)", [found["w1"], found["w2"]])
    return rounded(store.load("value (Daily)", [found["w2"], found["w3"]]), 2, "value")


@query("s10_incremental_store", f"""
SELECT scenario, {r("sum(value) * CASE scenario WHEN 'w2' THEN 3 ELSE 1 END", 2)} AS value, scenario = 'w2' AS rewritten, scenario IN ('w2', 'w5') AS read_again
FROM {HOURLY} GROUP BY 1""")
def _(spark, sf):
    """Four runs are loaded, one of them changes and a fifth comes: only these two are read, and one part is written anew."""
    root, out = area(spark, sf), scratch(spark)
    hourly = spark.read.option("header", True).option("inferSchema", True)
    runs = []
    for s in WEEKS:
        d = hourly.csv(f"{root}/inputs/{s}/raw.csv")
        sinks.write_csv(d, f"{out}/{s}/outputs/gen.csv")
        runs.append(scenarios.Scenario(s, f"{out}/{s}"))
    store = scenarios.ResultStore(spark, {"value": {"file": "gen.csv"}}, folder=f"{out}/store")
    store.load("value", runs[:4])
    before = store.manifest()["value"]
    tripled = hourly.csv(f"{root}/inputs/w2/raw.csv").withColumn("Generation", F.col("Generation") * 3)
    sinks.write_csv(tripled, f"{out}/w2/outputs/gen.csv", mode="overwrite")
    again = scenarios.ResultStore(spark, {"value": {"file": "gen.csv"}}, folder=f"{out}/store")  # as another session would
    d = again.load("value", runs)
    after = again.manifest()["value"]
    part = lambda m, x: m.get(x.path, {}).get("part")
    log = [(x.name, part(before, x) is not None and part(before, x) != part(after, x), part(before, x) != part(after, x)) for x in runs]
    log = spark.createDataFrame(log, "scenario string, rewritten boolean, read_again boolean")
    return rounded(d.groupBy("scenario").agg(F.sum("Generation").alias("value")).join(log, "scenario"), 2, "value")


@query("s11_lookup_scan", f"SELECT n_name AS area, r_name AS region, {r('sum(a)', 2)} AS a FROM {facts_sql('rb', 'a')} JOIN nation ON n_name = rb JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    from longview.operators import joins
    path = f"{scratch(spark)}/hierarchy.csv"
    look = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("area"), F.col("r_name").alias("region"))
    sinks.write_csv(look, path)
    lookup = csvfiles.scan(spark, [path])
    d = agg.aggregate(facts(spark, sf, "rb", "a").withColumnRenamed("rb", "area"), ["area"], "sum(a)", "a")
    return rounded(joins.join_attributes(d, lookup, "area"), 2, "a")


@query("s12_preamble_scan", f"""
SELECT CAST(year AS INTEGER) AS year, {', '.join(f"{r(f'sum(CASE WHEN tech = {chr(39)}{t}{chr(39)} THEN a END)', 2)} AS {t}" for t in TYPES)} FROM {facts_sql('year', 'tech', 'a')} GROUP BY 1""")
def _(spark, sf):
    path = f"{scratch(spark)}/sales"
    wide = rounded(reshape.pivot_first(agg.aggregate(facts(spark, sf, "year", "tech", "a"), ["year", "tech"], "sum(a)", "a"),
                                       ["year"], "tech", "a", TYPES), 2, *TYPES)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in wide.columns])
    # One line per calendar year: a single small file.
    text = wide.select(F.col("year").alias("at"), line.alias("value"))
    head = spark.createDataFrame([(-5, "Sales"), (-4, "from,the,tables"), (-3, ""), (-2, "million"), (-1, "Year," + ",".join(TYPES))], "at int, value string")
    head.unionByName(text).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    d = csvfiles.read_with_preamble(spark, path, 4)
    return d.select(F.col("Year").cast("int").alias("year"), *[F.col(t).cast("double").alias(t) for t in TYPES])


@query("s13_numbered_files", f"""
SELECT scenario AS filename, row_number() OVER (PARTITION BY scenario ORDER BY tech, month, day, hour) AS "HourID", tech AS category_name, month, day, hour AS "Hour", value AS "Generation" FROM {HOURLY}""")
def _(spark, sf):
    """Rows are numbered as they stand in their files, which are sorted here."""
    d = csvfiles.read_numbered(spark, by_file(spark, sf), "HourID")
    return d.select("filename", F.col("HourID").cast("long").alias("HourID"), "category_name", "month", "day", "Hour", "Generation")


@query("s15_listing", f"""
SELECT name, count(*) AS tables FROM (SELECT DISTINCT scenario, unnest(['gen.csv', 'total.csv']) AS name FROM {HOURLY}) GROUP BY 1""")
def _(spark, sf):
    """Tables of a tree of runs by name, from a listing that stays in tasks."""
    return csvfiles.tables_below(spark, f"{area(spark, sf)}/runs").groupBy("name").agg(F.count(F.lit(1)).alias("tables"))


@query("s1_headers", f"SELECT 'category_name,year,month,day,Hour,Generation' AS header, count(DISTINCT scenario) AS files FROM {HOURLY}")
def _(spark, sf):
    """Header line of every file of a folder: one row a file, none of its contents."""
    return with_headers(files_below(spark, by_file(spark, sf))).groupBy("header").agg(F.count(F.lit(1)).alias("files"))


GRAIN_COLS = {"Yearly": "year", "Monthly": "year, month", "Daily": "year, month, day", "Hourly": "year, month, day, hour"}


@query("s14_catalog_rollups", " UNION ALL ".join(
    f"SELECT 'value ({g})' AS result, tech, year, {', '.join(c if c in k else f'CAST(NULL AS INTEGER) AS {c}' for c in ('month', 'day', 'hour'))}, {r('sum(CASE WHEN value < 5 THEN 0 ELSE value END)', 2)} AS value "
    f"FROM {HOURLY} WHERE scenario <> 'w5' GROUP BY tech, {k}" for g, k in GRAIN_COLS.items()))
def _(spark, sf):
    cat = _catalog(spark, sf)
    found = scenarios.discover_scenarios(spark, f"{area(spark, sf)}/runs")
    out = []
    for grain in GRAIN_COLS:
        d = scenarios.read_result(spark, found, {k: v for k, v in cat[f"value ({grain})"].items() if k not in ("index", "columns")})
        keys = [c for c in d.columns if c in ("tech", "year", "month", "day", "hour")]
        out.append(agg.aggregate(d, keys, "sum(a)", "value").withColumn("result", F.lit(f"value ({grain})")))
    return rounded(reshape.union_by_name(*out), 2, "value").select("result", "tech", "year", "month", "day", "hour", "value")


@query("s15_unique_tables", f"SELECT 'gen.csv' AS name, (SELECT count(*) FROM {HOURLY} WHERE scenario = 'w5') AS rows")
def _(spark, sf):
    last = csvfiles.unique_by_name(spark, f"{area(spark, sf)}/runs")["gen.csv"]
    return csvfiles.scan(spark, [last], infer=False).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("gen.csv").alias("name"), "rows")


@query("s16_parameters", f"SELECT l_orderkey, l_linenumber, {r('l_quantity / (SELECT max(l_quantity) FROM lineitem)', 6)} AS q FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    path = f"{scratch(spark)}/scalars.csv"
    params = li.agg(F.max("l_quantity").cast("string").alias("q_max"), F.min("l_quantity").cast("string").alias("q_min"))
    sinks.write_csv(params.unpivot([], ["q_max", "q_min"], "scalar", "value"), path)
    top = csvfiles.parameter(csvfiles.read_parameters(spark, path, "scalar"), "scalar", "q_max")
    return rounded(li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / top).alias("q")), 6, "q")


# ---- column mapper -------------------------------------------------------------------

DIMS = {"Dim1": "p_type", "year": "Year", "month": "Month", "day": 31, "hour": 23, "val": "l_extendedprice", "Dim2": "p_brand", "Dim3": "all parts"}


def _raw(spark, sf):
    return facts(spark, sf, "tech", "brand", "year", "month", "a").toDF("p_type", "p_brand", "Year", "Month", "l_extendedprice")


@query("m1_apply_mapping", f"SELECT tech AS \"Dim1\", year, month, 31 AS day, 23 AS hour, brand AS \"Dim2\", 'all parts' AS \"Dim3\", a AS l_extendedprice FROM {facts_sql('tech', 'brand', 'year', 'month', 'a')}")
def _(spark, sf):
    return mapping.apply_mapping(_raw(spark, sf), DIMS)


@query("m2_value_last", f"SELECT tech AS \"Dim1\", {r('sum(a)', 2)} AS l_extendedprice FROM {facts_sql('tech', 'a')} GROUP BY 1")
def _(spark, sf):
    d = mapping.apply_mapping(_raw(spark, sf), {"val": "l_extendedprice", "Dim1": "p_type"})
    return rounded(d.groupBy(d.columns[0]).agg(F.sum(d.columns[-1]).alias(d.columns[-1])), 2, "l_extendedprice")


@query("m3_time_detection", f"SELECT flag AS \"Dim1\", year, month, 31 AS day, 23 AS hour, {r('sum(b)', 2)} AS qty FROM {facts_sql('flag', 'year', 'month', 'b')} GROUP BY 1, 2, 3")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "flag", "year", "month", "b"), ["flag", "year", "month"], "sum(a)", "b").toDF("birthday_flag", "Ship_Year", "shipMonth", "qty")
    return rounded(mapping.apply_mapping(d, {"Dim1": "birthday_flag", **mapping.detect_time_columns(d.columns), "val": "qty"}), 2, "qty")


@query("m4_mapping_order", f"SELECT tech AS \"Dim1\", year, brand AS \"Dim2\", a AS l_extendedprice FROM {facts_sql('tech', 'brand', 'year', 'a')}")
def _(spark, sf):
    d = mapping.apply_mapping(_raw(spark, sf), {"Dim2": "p_brand", "val": "l_extendedprice", "year": "Year", "Dim1": "p_type"})
    assert d.columns == ["Dim1", "year", "Dim2", "l_extendedprice"]
    return d


@query("m5_mapping_store", f"SELECT tech AS \"Dim1\", year, a AS l_extendedprice FROM {facts_sql('tech', 'year', 'a')}")
def _(spark, sf):
    store = mapping.MappingStore(f"{scratch(spark)}/mappings.json", spark)
    store.save("gen", "raw.csv", {"Dim1": "p_type", "year": "Year", "val": "l_extendedprice"})
    store.save("other", "raw.csv", DIMS)
    store.delete("other")
    return mapping.apply_mapping(_raw(spark, sf), store.load()["gen"]["dimensions"])


@query("m6_map_tree", f"SELECT scenario, tech AS \"Dim1\", year, month, day, hour, value AS \"Generation\" FROM {HOURLY}")
def _(spark, sf):
    root = area(spark, sf)
    store = mapping.MappingStore(f"{scratch(spark)}/mappings.json", spark)
    store.save("gen", "raw.csv", {"Dim1": "category_name", "year": "year", "month": "month", "day": "day", "hour": "Hour", "val": "Generation"})
    out = f"{scratch(spark)}/runs"
    mapping.apply_all(spark, store, f"{root}/inputs", out)
    found = scenarios.discover_scenarios(spark, out)
    return scenarios.read_source(spark, found, {"file": "gen.csv"}).toDF("Dim1", "year", "month", "day", "hour", "Generation", "scenario")


# ---- sinks ---------------------------------------------------------------------------

VIEW = {"x": "year", "y": "a", "series": "tech", "explode": "scenario"}
VIEW_SQL = f"SELECT scenario, tech, year, {r('sum(a)', 2)} AS a FROM {facts_sql('scenario', 'tech', 'year', 'a')} GROUP BY 1, 2, 3"


def _view(spark, sf):
    return rounded(run_view(facts(spark, sf, "scenario", "tech", "year", "flag", "a"), VIEW), 2, "a")


@query("k1_view_csv", VIEW_SQL)
def _(spark, sf):
    path = sinks.write_csv(_view(spark, sf), f"{scratch(spark)}/{sinks.output_name('view', 'my')}.csv")
    return csvfiles.scan(spark, [path], "scenario string, tech string, year int, a double")


@query("k2_source_csv", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def _(spark, sf):
    path = sinks.write_csv(table(spark, sf, "lineitem").select(*LINE_COLS), f"{scratch(spark)}/source.csv")
    return csvfiles.scan(spark, [path], LINE)


SECTIONS = [{"name": "Value: by year", "config": {"x": "year", "y": "a", "series": "tech"}},
            {"name": "Broken", "config": {"x": "missing", "y": "a"}},
            {"name": "Whole source", "download_full_source": True, "modify": "none"}]


@query("k3_report_sections", f"""
SELECT '1_Value- by year' AS section, count(*) AS rows FROM (SELECT DISTINCT tech, year FROM {facts_sql('tech', 'year')})
UNION ALL SELECT '3_Whole source', count(*) FROM {facts_sql('scenario', 'tech')}""")
def _(spark, sf):
    done = _report(spark, sf, SECTIONS)
    parts = [csvfiles.scan(spark, [d.path], infer=False).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(d.path.rsplit("/", 1)[1].removesuffix(".csv")).alias("section"), "rows") for d in done if d.path]
    assert [d.name for d in done if d.error] == ["Broken"]
    return reshape.union_by_name(*parts)


def _report(spark, sf, sections, **kw):
    import logging
    logging.getLogger("longview.plans.report").setLevel(logging.ERROR)
    return report.run_report(spark, facts(spark, sf, "scenario", "tech", "year", "a"), sections, scratch(spark), **kw)


@query("k4_full_source_section", f"SELECT scenario, tech, year, a FROM {facts_sql('scenario', 'tech', 'year', 'a')}")
def _(spark, sf):
    done = _report(spark, sf, SECTIONS[2:])
    return csvfiles.scan(spark, [done[0].path], "scenario string, tech string, year int, a double")


@query("k5_safe_names", "SELECT DISTINCT o_orderpriority AS name, regexp_replace(o_orderpriority || ':' || o_orderstatus || '?', '[\\\\/:\"*?<>|]', '-', 'g') AS safe FROM orders")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.concat("o_orderpriority", F.lit(":"), "o_orderstatus", F.lit("?")).alias("t")).distinct()
    return d.select("name", F.regexp_replace("t", sinks.FORBIDDEN, "-").alias("safe"))


@query("k6_headerless_export", f"SELECT tech AS _c0, CAST(year AS VARCHAR) AS _c1, {r('sum(b)', 2)} AS b FROM {facts_sql('tech', 'year', 'b')} GROUP BY 1, 2")
def _(spark, sf):
    d = agg.aggregate(facts(spark, sf, "tech", "year", "b"), ["tech", "year"], "sum(a)", "b")
    path = sinks.write_csv(d, f"{scratch(spark)}/ref.csv", header=False)
    return spark.read.csv(path).select("_c0", "_c1", F.round(F.col("_c2").cast("double"), 2).alias("b"))


@query("k7_spec_round_trip", VIEW_SQL)
def _(spark, sf):
    spec = ViewSpec.from_dict({**VIEW, "x_group": "None", "plot_width": "300"})
    again = ViewSpec.from_json(spec.to_json())
    assert again == spec and set(json.loads(spec.to_json())) == set(VIEW)
    return rounded(run_view(facts(spark, sf, "scenario", "tech", "year", "flag", "a"), again), 2, "a")


@query("k8_build_info", "SELECT 'base' AS item, min(o_orderpriority) AS value FROM orders UNION ALL SELECT 'Data Source', 'facts'")
def _(spark, sf):
    base = table(spark, sf, "orders").agg(F.min("o_orderpriority")).first()[0]
    done = _report(spark, sf, SECTIONS[:1], sources=["facts"], defaults={"base": base})
    folder = done[0].path.rsplit("/", 1)[0]
    return csvfiles.scan(spark, [f"{folder}/meta.csv"], "item string, value string").filter("item <> 'Build date/time'")


@query("k9_new_folder_per_build", f"SELECT 2 AS builds, count(*) AS rows FROM (SELECT DISTINCT tech, year FROM {facts_sql('tech', 'year')})")
def _(spark, sf):
    import datetime
    out = scratch(spark)
    src = facts(spark, sf, "tech", "year", "a")
    when = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in (1, 2)]
    paths = {report.run_report(spark, src, SECTIONS[:1], out, now=t)[0].path for t in when}
    d = csvfiles.scan(spark, [max(paths)], infer=False)
    return d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(len(paths)).alias("builds"), "rows")


@query("t14_write_panels", VIEW_SQL)
def _(spark, sf):
    path = sinks.write_panels(_view(spark, sf), f"{scratch(spark)}/panels", "tech", "scenario")
    return spark.read.parquet(path).withColumn("scenario", F.col("scenario").cast("string"))


# ---- extension surface ---------------------------------------------------------------

@query("x1_step_chain", f"SELECT tech, year, {r('sum(a) * 1e-6', 8)} AS a FROM {facts_sql('tech', 'year', 'a')} GROUP BY 1, 2")
def _(spark, sf):
    steps = [{"func": agg.sum_over, "args": {"group_cols": ["tech", "year"], "val_cols": ["a"]}},
             {"func": project.scale, "args": {"column": "a", "factor": 1e-6}}]
    return rounded(scenarios.run_steps(facts(spark, sf, "tech", "year", "flag", "a"), steps), 8, "a")


@query("x2_several_inputs", f"SELECT tech, {r('sum(a) / (SELECT sum(c_acctbal) FROM customer)', 6)} AS a FROM {facts_sql('tech', 'a')} GROUP BY 1")
def _(spark, sf):
    from longview.functions import scalars as S

    def merge(dfs, factor):
        total = dfs["balance"].agg(F.sum("c_acctbal")).scalar()
        return dfs["value"].groupBy("tech").agg((F.sum("a") * factor).alias("a")).withColumn("a", S.ratio("a", total))

    data = {"value": facts(spark, sf, "tech", "a"), "balance": table(spark, sf, "customer")}
    return rounded(scenarios.run_steps(data, [{"func": merge, "args": {"factor": 1.0}}]), 6, "a")


@query("x3_column_functions", "SELECT p_partkey, upper(substring(p_name, 1, 3)) AS p_name, p_size FROM part")
def _(spark, sf):
    meta = {"p_name": {"preprocess": [lambda c: F.substring(c, 1, 3), F.upper]}}
    return scenarios.apply_column_functions(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), meta)


@query("x6_report_with_differences", f"""
WITH g AS (SELECT scenario, tech, year, sum(a) / 1e6 AS a FROM {facts_sql('scenario', 'tech', 'year', 'a')} GROUP BY 1, 2, 3)
SELECT 'v_base' AS section, scenario, tech, year, {r('a', 8)} AS a FROM g WHERE scenario = '1-URGENT'
UNION ALL SELECT 'v_diff', g.scenario, g.tech, g.year, {r('g.a - coalesce(b.a, 0)', 8)} FROM g LEFT JOIN g b ON b.scenario = '1-URGENT' AND b.tech = g.tech AND b.year = g.year WHERE g.scenario <> '1-URGENT'""")
def _(spark, sf):
    d = facts(spark, sf, "scenario", "tech", "year", "a")
    preset = {"value": {"presets": {"lines": {"x": "year", "y": "a", "series": "tech", "explode": "scenario"}}}}
    sections = [{"name": "Value", "result": "value", "preset": "lines", "sheet_name": "v", "config": {"y_scale": 1e-6}}]
    done = report.run_report(spark, lambda name: d, sections, scratch(spark), "Base + Diff", "1-URGENT", preset, fmt="parquet")
    parts = [spark.read.parquet(x.path).withColumn("section", F.lit(x.path.rsplit("/", 1)[1].removesuffix(".parquet"))) for x in done]
    return rounded(reshape.union_by_name(*parts), 8, "a")


@query("x7_spec_validation", "SELECT 'base ' || p_type || ' of tech: ' || CASE WHEN p_type = 'PROMO' THEN 'unknown' ELSE 'fine' END AS outcome FROM (SELECT DISTINCT p_type FROM part)")
def _(spark, sf):
    from longview.plans import view
    d = facts(spark, sf, "tech", "year", "a")
    kinds = d.select(F.col("tech").cast("string").alias("value")).distinct()
    unknown = view.unknown_bases(kinds, d.filter("tech <> 'PROMO'"), "tech")
    outcome = F.when(F.col("unknown"), "unknown").otherwise("fine")
    return unknown.select(F.concat(F.lit("base "), F.col("value"), F.lit(" of tech: "), outcome).alias("outcome"))


def _report_mode(mode):
    def f(spark, sf):
        d = facts(spark, sf, "scenario", "tech", "year", "a")
        preset = {"value": {"presets": {"lines": {"x": "year", "y": "a", "series": "tech", "explode": "scenario"}}}}
        sections = [{"name": "Value", "result": "value", "preset": "lines", "sheet_name": "v", "config": {"y_scale": 1e-6}}]
        done = report.run_report(spark, lambda name: d, sections, scratch(spark), mode, "1-URGENT", preset, fmt="parquet")
        parts = [spark.read.parquet(x.path).withColumn("section", F.lit(x.path.rsplit("/", 1)[1].removesuffix(".parquet"))) for x in done]
        return rounded(reshape.union_by_name(*parts), 8, "a")
    return f


_SCALED = f"WITH g AS (SELECT scenario, tech, year, sum(a) / 1e6 AS a FROM {facts_sql('scenario', 'tech', 'year', 'a')} GROUP BY 1, 2, 3)"
_DIFF = f"SELECT 'v_diff' AS section, g.scenario, g.tech, g.year, {r('g.a - coalesce(b.a, 0)', 8)} AS a FROM g LEFT JOIN g b ON b.scenario = '1-URGENT' AND b.tech = g.tech AND b.year = g.year WHERE g.scenario <> '1-URGENT'"
query("x6_report_diff_only", f"{_SCALED} {_DIFF}")(_report_mode("Diff Only"))
query("x6_report_yes", f"{_SCALED} {_DIFF} UNION ALL SELECT 'v', scenario, tech, year, {r('a', 8)} FROM g")(_report_mode("Yes"))


@query("s5_equal_run_names", f"SELECT CASE scenario WHEN 'w1' THEN 'a/run' ELSE 'b/run' END AS scenario, {r('sum(value)', 2)} AS value FROM {HOURLY} WHERE scenario IN ('w1', 'w2') GROUP BY 1")
def _(spark, sf):
    base = scratch(spark)
    d = events(spark, sf, "scenario", "tech", "year", "month", "day", "hour", "value")
    hourly = rounded(agg.sum_over(d, ["scenario", "tech", "year", "month", "day", "hour"], val_cols=["value"]), 2, "value")
    for s, parent in (("w1", "a"), ("w2", "b")):
        sinks.write_csv(hourly.filter(F.col("scenario") == s).drop("scenario"), f"{base}/{parent}/run/outputs/gen.csv")
        sinks.write_marker(spark, f"{base}/{parent}/run/outputs/BP.csv")
    found = scenarios.discover_scenarios(spark, f"{base}/a|{base}/b")
    store = scenarios.ResultStore(spark, {"value": {"file": "gen.csv"}})
    store.load("value", found[:1])
    d = store.load("value", found).groupBy("scenario").agg(F.sum("value").alias("value"))
    return rounded(d, 2, "value")
