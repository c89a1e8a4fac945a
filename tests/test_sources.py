"""CSV sources, scenarios, catalogue, mapper and sinks on hand-written trees."""

import datetime

import pytest
from pyspark.sql import functions as F

from longview.operators import aggregate
from longview.sources import catalog, csvfiles, listing, mapping, scenarios, sinks


def put(root, path, text):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)
    return str(f)


@pytest.fixture
def runs(tmp_path):
    """Two marked runs (one with a space and a plus in its name) and an unmarked one."""
    for run, v in [("Base Case", "1"), ("High+Tech", "2"), ("draft", "9")]:
        put(tmp_path, f"runs/{run}/outputs/gen.csv", f"Dim1,year,month,day,hour,Gen\nCOAL,2020,1,1,0,{v}\nWind,2020,1,1,1,Eps\nCOAL,2021,2,1,0,{v}5\n")
        put(tmp_path, f"runs/{run}/outputs/sw.csv", f"a,b\n1,{v}\n")
        if run != "draft":
            put(tmp_path, f"runs/{run}/outputs/BP.csv", "marker\n")
    return tmp_path


def test_files_directories_and_pipes(spark, tmp_path, rows):
    a = put(tmp_path, "d/a.csv", "k,v\nx,1\ny,2\n")
    b = put(tmp_path, "d/b.csv", "v,k,extra\n3,z,q\n")
    put(tmp_path, "d/sub/c.csv", "k,v\nno,9\n")
    assert rows(csvfiles.read_csv_source(spark, a)) == [("x", 1), ("y", 2)]
    d = csvfiles.read_csv_source(spark, str(tmp_path / "d"))
    assert rows(d, "k", "v", "extra", "filename") == [("x", 1, None, "a"), ("y", 2, None, "a"), ("z", 3, "q", "b")]
    two = csvfiles.read_csv_source(spark, f'"{a}" | {b}')
    assert rows(two, "k", "filename") == [("x", "a"), ("y", "a"), ("z", "b")]


def test_preamble_and_numbering(spark, tmp_path, rows):
    p = put(tmp_path, "p.csv", "Title\nYear,North\n,,\nunits\nYear,North\n2010,5\n2011,6\n")
    assert rows(csvfiles.read_with_preamble(spark, p, 4)) == [("2010", "5"), ("2011", "6")]
    for s in "AB":
        put(tmp_path, f"shapes/{s}.csv", "heat,cool\n" + "".join(f"{s}{i},{i}\n" for i in range(1, 6)))
    d = csvfiles.read_numbered(spark, str(tmp_path / "shapes"))
    assert rows(d.filter("HourID = 4"), "filename", "HourID", "heat") == [("A", 4, "A4"), ("B", 4, "B4")]
    assert d.count() == 10


def test_numbering_across_blocks_of_one_file(spark, tmp_path):
    put(tmp_path, "big/x.csv", "n\n" + "".join(f"{i:08d}\n" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = csvfiles.read_numbered(spark, str(tmp_path / "big"), "id", "n string")
        assert d.rdd.getNumPartitions() > 1
        assert d.filter(F.col("n").cast("int") != F.col("id")).count() == 0 and d.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_discovery(spark, runs):
    root = str(runs / "runs")
    assert [s.name for s in scenarios.discover_scenarios(spark, root)] == ["Base Case", "High+Tech"]
    assert [s.name for s in scenarios.discover_scenarios(spark, f"{root}/Base Case")] == ["Base Case"]
    assert scenarios.discover_scenarios(spark, f"{root}/draft") == []
    listing = put(runs, "list.csv", f"name,color,path\nHigh,#111111,{root}/High+Tech\nGone,#222222,{root}/none\nLow,#333333,{root}/Base Case\n")
    assert [(s.name, s.color) for s in scenarios.discover_scenarios(spark, listing)] == [("High", "#111111"), ("Low", "#333333")]


def test_read_source(spark, runs, rows):
    found = scenarios.discover_scenarios(spark, str(runs / "runs"))
    d = scenarios.read_source(spark, found, {"file": "gen.csv", "columns": ["tech", "year", "month", "day", "hour", "Gen"]})
    assert rows(d, "scenario", "tech", "year", "Gen") == [
        ("Base Case", "coal", 2020, 1.0), ("Base Case", "coal", 2021, 15.0), ("Base Case", "wind", 2020, 0.0),
        ("High+Tech", "coal", 2020, 2.0), ("High+Tech", "coal", 2021, 25.0), ("High+Tech", "wind", 2020, 0.0)]


def test_catalog_result_and_store(spark, runs, rows):
    root = str(runs / "runs")
    cat = catalog.build_catalog(spark, root)
    assert "Gen (Yearly)" in cat and list(cat) == sorted(cat)
    assert cat["Gen (Daily)"]["presets"]["Stacked Bars"]["filter"] == {"year": "last", "month": "last"}
    found = scenarios.discover_scenarios(spark, root)
    d = scenarios.read_result(spark, found, cat["Gen (Yearly)"])
    assert d.count() == 2 * 2 * 2  # scenario x tech x year, gaps filled
    assert ("Base Case", "wind", 2021, 0.0) in rows(d, "scenario", "tech", "year", "Gen")
    store = scenarios.ResultStore(spark, cat)
    assert store.load("Gen (Yearly)", found[:1]).select("scenario").distinct().count() == 1
    assert store.load("Gen (Yearly)", found).count() == 8
    parts = {p.rsplit("/", 1)[1]: e["part"] for p, e in store.manifest()["Gen (Yearly)"].items()}
    assert sorted(parts) == ["Base Case", "High+Tech"]
    assert store.load("Gen (Yearly)", found[1:]).select("scenario").distinct().count() == 1
    assert {p.rsplit("/", 1)[1]: e["part"] for p, e in store.manifest()["Gen (Yearly)"].items()} == parts  # nothing was read again
    store.clear()


def test_store_reads_changed_and_new_runs_only(spark, runs, rows, tmp_path):
    found = scenarios.discover_scenarios(spark, str(runs / "runs"))
    made = {"Gen": {"file": "gen.csv", "columns": ["tech", "year", "month", "day", "hour", "Gen"]}}
    store = scenarios.ResultStore(spark, made, folder=str(tmp_path / "store"))
    state = lambda s: {p.rsplit("/", 1)[1]: e["part"] for p, e in s.manifest().get("Gen", {}).items()}
    assert store.load("Gen", found[:1]).count() == 3
    first = state(store)
    again = scenarios.ResultStore(spark, made, folder=str(tmp_path / "store"))  # another session's view of the same folder
    assert again.load("Gen", found).count() == 6
    second = state(again)
    assert second["Base Case"] == first["Base Case"] and set(second) == {"Base Case", "High+Tech"}
    put(runs, "runs/Base Case/outputs/gen.csv", "Dim1,year,month,day,hour,Gen\nCOAL,2020,1,1,0,100.5\n")
    d = again.load("Gen", found)
    assert sorted(r.Gen for r in d.filter("scenario = 'Base Case'").collect()) == [100.5] and d.count() == 4
    third = state(again)
    assert third["High+Tech"] == second["High+Tech"] and third["Base Case"] != second["Base Case"]
    assert not (tmp_path / "store").joinpath(second["Base Case"].split("/store/")[1]).exists()  # the old part is gone
    # A column that is text in one run only is text, also for the run that was loaded before.
    put(runs, "runs/Base Case/outputs/gen.csv", "Dim1,year,month,day,hour,Gen\nCOAL,2020,1,1,0,none\n")
    d = again.load("Gen", found)
    assert dict(d.dtypes)["Gen"] == "string" and sorted(r.Gen for r in d.collect())[-1] == "none"
    whole = scenarios.read_source(spark, found, made["Gen"])
    assert whole.dtypes == d.select(*whole.columns).dtypes and rows(whole) == rows(d.select(*whole.columns))
    # Without that run the other's numbers are numbers again.
    alone = again.load("Gen", [x for x in found if x.name != "Base Case"])
    assert dict(alone.dtypes)["Gen"] == "double" and sorted(r.Gen for r in alone.collect()) == [0.0, 2.0, 25.0]
    # Another definition of the result is another state.
    other = scenarios.ResultStore(spark, {"Gen": made["Gen"] | {"preprocess": [{"func": aggregate.sum_over, "args": {"group_cols": ["year"]}}]}}, folder=str(tmp_path / "store"))
    put(runs, "runs/Base Case/outputs/gen.csv", "Dim1,year,month,day,hour,Gen\nCOAL,2020,1,1,0,7\n")
    other.load("Gen", found)
    assert all(state(other)[k] != third[k] for k in third)
    assert sorted(r.Gen for r in again.load("Gen", found[:1]).collect()) == [7.0]
    other.clear()
    assert not (tmp_path / "store").exists()


def test_headers_read_a_bounded_part(spark, tmp_path):
    wide = ",".join(f"column_{i}" for i in range(4000))  # a header longer than one ranged read
    put(tmp_path, "h/a.csv", wide + "\n" + "1,2\n" * 200_000)
    put(tmp_path, "h/b.csv", "x,y")  # no line end
    put(tmp_path, "h/c.csv", "")
    put(tmp_path, "h/t.csv/part-0.csv", "p,q\r\n1,2\r\n")
    put(tmp_path, "h/t.csv/_SUCCESS", "")
    files = [str(tmp_path / "h" / n) for n in ("a.csv", "b.csv", "c.csv", "t.csv")]
    assert listing.headers_of(spark, files) == dict(zip(files, [wide, "x,y", "", "p,q"]))
    below = listing.files_below(spark, str(tmp_path / "h"), "*.csv")
    assert sorted(r.path.rsplit("/h/", 1)[1] for r in below.collect()) == ["a.csv", "b.csv", "c.csv", "t.csv/part-0.csv"]
    assert [r.path[-5:] for r in listing.files_below(spark, str(tmp_path / "h"), "b*", recursive=False).collect()] == ["b.csv"]
    assert listing.files_below(spark, str(tmp_path / "none")).collect() == []


def test_many_files_in_one_job(spark, tmp_path):
    for i in range(300):
        put(tmp_path, f"m/run{i % 30}/sub/f{i}.csv", f"k,v{i % 2}\n{i},1\n")
    h = listing.with_headers(listing.files_below(spark, str(tmp_path / "m")))
    assert {(r.header, r["count"]) for r in h.groupBy("header").count().collect()} == {("k,v0", 150), ("k,v1", 150)}
    assert csvfiles.tables_below(spark, str(tmp_path / "m")).count() == 300


def test_runs_are_published_whole(spark, tmp_path, rows):
    d = spark.createDataFrame([("a", 1), ("b c", 2), (".", 3)], "scenario string, v int")
    d.write.partitionBy("scenario").option("header", True).csv(str(tmp_path / "stage"))
    sinks.publish_runs(spark, {str(tmp_path / "stage"): "outputs/x.csv"}, str(tmp_path / "out"), "scenario", "outputs/BP.csv")
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("BP.csv")) == ["a/outputs/BP.csv", "b c/outputs/BP.csv", "outputs/BP.csv"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/b c/outputs/x.csv")).first().v == "2"
    d.write.partitionBy("scenario").option("header", True).csv(str(tmp_path / "stage"))
    (tmp_path / "out/a/outputs/BP.csv").unlink()
    with pytest.raises(FileExistsError):
        sinks.publish_runs(spark, {str(tmp_path / "stage"): "outputs/x.csv"}, str(tmp_path / "out"), "scenario", "outputs/BP.csv")
    assert not (tmp_path / "out/a/outputs/BP.csv").exists()  # nothing moved, no marker


def test_several_sources_and_column_functions(spark, runs, rows):
    found = scenarios.discover_scenarios(spark, str(runs / "runs"))
    def merge(dfs, by):
        return dfs["g"].groupBy(*by).agg(F.sum("Gen").alias("Gen")).crossJoin(dfs["s"].select("b"))
    result = {"sources": [{"name": "g", "file": "gen.csv"}, {"name": "s", "file": "sw.csv"}],
              "preprocess": [{"func": merge, "args": {"by": ["Dim1"]}}]}
    d = scenarios.read_result(spark, found, result, {"Dim1": {"preprocess": [F.upper]}})
    assert ("High+Tech", "COAL", 27.0, 2) in rows(d, "scenario", "Dim1", "Gen", "b")


def test_detect_time_columns():
    assert mapping.detect_time_columns(["birthday", "Ship_Year", "monthName", "myHour"]) == {"year": "Ship_Year", "month": "monthName", "day": 31, "hour": "myHour"}


def test_mapper_writes_runs_the_loader_reads(spark, tmp_path, rows):
    for run in ("A", "B 2"):
        put(tmp_path, f"in/{run}/fake.csv", "category_name,year,Generation\ncoal,2020,1.5\nwind,2020,2\n")
    put(tmp_path, "in/other.csv", "x\n1\n")
    store = mapping.MappingStore(str(tmp_path / "maps.json"))
    store.save("gen", "fake.csv", {"val": "Generation", "Dim1": "category_name", "year": "year", "month": 12, "day": 31, "hour": 23, "Dim2": "all"})
    assert list(store.load()["gen"]["dimensions"]) == ["Dim1", "year", "month", "day", "hour", "val", "Dim2"]
    mapping.apply_all(spark, store, str(tmp_path / "in"), str(tmp_path / "runs"))
    found = scenarios.discover_scenarios(spark, str(tmp_path / "runs"))
    assert [s.name for s in found] == ["A", "B 2"]
    d = scenarios.read_source(spark, found, {"file": "gen.csv"})
    assert d.columns == ["Dim1", "year", "month", "day", "hour", "Dim2", "Generation", "scenario"]
    assert ("wind", 2020, 12, 31, 23, "all", 2.0, "B 2") in rows(d)
    mapping.apply_all(spark, store, str(tmp_path / "in"), str(tmp_path / "flat"), partitioned=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "flat/gen")).count() == 4
    store.delete("gen")
    assert store.names() == []


def test_store_on_shared_storage(spark, tmp_path):
    store = mapping.MappingStore(str(tmp_path / "m.json"), spark)
    assert store.load() == {}
    store.save("a", "x.csv", {"Dim1": "k"})
    store.save("b", "x.csv", {"Dim1": "k"})
    store.delete("a")
    assert mapping.MappingStore(str(tmp_path / "m.json"), spark).names() == ["b"]


def test_unique_tables(spark, runs):
    last = csvfiles.unique_by_name(spark, str(runs / "runs"))
    assert last["gen.csv"].endswith("draft/outputs/gen.csv")


def test_names_and_panels(spark, tmp_path):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert sinks.safe_name('a/b:c?"d"') == "a-b-c--d-"
    assert sinks.output_name("view", "p", True, when) == "p-view-2024-01-02-03-04-05"
    df = spark.createDataFrame([("g", "e1", 1.0), ("g", "e2", 2.0)], "grp string, e string, y double")
    sinks.write_panels(df, str(tmp_path / "p"), "e", "grp")
    assert (tmp_path / "p" / "grp=g" / "e=e2").is_dir()


def test_parameters(spark, tmp_path):
    p = put(tmp_path, "sw.csv", "switch,value\nyears,20\nname,x\n")
    t = csvfiles.read_parameters(spark, p, "switch")
    assert spark.range(1).select((csvfiles.parameter(t, "switch", "years") + 1).alias("n")).first().n == 21.0
