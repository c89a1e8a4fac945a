"""Scenario discovery and result loading."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType, StructField, StructType

from longview.operators import aggregate, joins, project, ranking, reshape
from longview.shared import hadoop_path, new_folder
from longview.sources import csvfiles, sinks
from longview.sources.listing import plain_path, states_of

# Layout of a run folder.
OUTPUT_DIR = "outputs"
MARKER = "BP.csv"


@dataclass(frozen=True)
class Scenario:
    name: str
    path: str
    color: str | None = None


def _marked_runs(spark: SparkSession, glob: str) -> list[str]:
    try:
        found = spark.read.format("binaryFile").load(glob).select("path").distinct().collect()
    except AnalysisException:
        return []
    tail = f"/{OUTPUT_DIR}/"
    return sorted({r[0][:r[0].rindex(tail)] for r in found})


def discover_scenarios(spark: SparkSession, paths: str, marker: str = MARKER) -> list[Scenario]:
    """Runs behind a pipe list of run folders, parents of run folders or scenario lists.

    A run counts if its output folder holds the marker.  A list file fixes names,
    order and colours.  Runs of equal name keep apart: they are known by their folder.
    """
    out: list[Scenario] = []
    for p in csvfiles.split_paths(paths):
        if p.lower().endswith(".csv"):
            rows = spark.read.option("header", True).csv(p)
            has_color = "color" in rows.columns
            for r in rows.collect():
                if _marked_runs(spark, f"{r['path'].rstrip('/')}/{OUTPUT_DIR}/{marker}"):
                    out.append(Scenario(r["name"], r["path"].rstrip("/"), r["color"] if has_color else None))
            continue
        own = _marked_runs(spark, f"{p}/{OUTPUT_DIR}/{marker}")
        for run in own or _marked_runs(spark, f"{p}/*/{OUTPUT_DIR}/{marker}"):
            out.append(Scenario(run.rsplit("/", 1)[1], run))
    return unique_names(list({(s.name, s.path): s for s in out}.values()))


def _run_folder():
    # File paths arrive URL-encoded; a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, rf"^(.*)/{OUTPUT_DIR}/", 1)
    return F.regexp_replace(folder, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def unique_names(runs: list[Scenario]) -> list[Scenario]:
    """Runs whose names differ in more than case: a repeated name gets its parent folder in front, then its number."""
    seen: dict[str, int] = {}
    for s in runs:
        seen[s.name.lower()] = seen.get(s.name.lower(), 0) + 1
    out, used = [], set()
    for s in runs:
        name = s.name
        if seen[name.lower()] > 1:
            parent = s.path.rstrip("/").rsplit("/", 2)
            name = f"{parent[-2]}/{name}" if len(parent) > 2 else name
        first, n = name, 2
        while name.lower() in used:
            name, n = f"{first} ({n})", n + 1
        used.add(name.lower())
        out.append(Scenario(name, s.path, s.color))
    return out


def read_source(spark: SparkSession, scenarios: list[Scenario], src: dict) -> DataFrame:
    """One result table of several runs in one scan, tagged with ``scenario``.

    ``src``: ``file``; optional ``columns`` (positional rename), ``header`` (None for
    none), ``transpose``, ``schema``, ``texts`` (columns that stay text).  Sentinels become 0, text columns that hold only
    numbers become numeric, text is lowercased.
    """
    files = [f"{s.path}/{OUTPUT_DIR}/{src['file']}" for s in scenarios]
    header = not ("header" in src and src["header"] is None)
    texts, extra = tuple(src.get("texts", ())), {"__run": _run_folder()}
    raw = csvfiles.scan(spark, files, src.get("schema"), header=header, extra=extra)
    if texts and any(k != "string" for c, k in (raw if "columns" not in src else raw.toDF(*src["columns"], "__run")).dtypes if c in texts):
        # What was inferred as a number in these runs is read again as it is written: by name, so one layout at a time.
        parts = []
        for f in files:
            kinds = csvfiles.scan(spark, [f], header=header).schema
            named = src.get("columns", kinds.names)
            kinds = StructType([StructField(k.name, StringType() if n in texts else k.dataType) for k, n in zip(kinds, named)])
            parts.append(csvfiles.scan(spark, [f], kinds, header=header, extra=extra))
        raw = csvfiles.united(parts)
    run = raw["__run"]
    if src.get("transpose"):
        return _transposed(raw, scenarios, src)
    body = raw.drop("__run")
    if "columns" in src:
        raw = raw.toDF(*src["columns"], "__run")
        run = raw["__run"]
        body = raw.drop("__run")
    names = F.create_map(*[F.lit(v) for s in scenarios for v in (plain_path(s.path), s.name)])
    tagged = raw.withColumn("scenario", F.try_element_at(names, run)).drop("__run")
    clean = project.lowercase_strings(project.clean_sentinels(tagged.select(*body.columns, "scenario"), keep=texts))
    lower_to_name = F.create_map(*[F.lit(v) for s in scenarios for v in (s.name.lower(), s.name)])
    return clean.withColumn("scenario", F.try_element_at(lower_to_name, F.lower("scenario")))


def _transposed(raw: DataFrame, scenarios: list[Scenario], src: dict) -> DataFrame:
    """Transposed sources are small parameter tables: one run at a time."""
    frames = []
    for s in scenarios:
        one = raw.filter(F.col("__run") == plain_path(s.path)).drop("__run")
        flipped = reshape.transpose(one, one.columns[0])
        flipped = flipped.toDF(*src["columns"]) if "columns" in src else flipped
        flipped = project.lowercase_strings(project.clean_sentinels(flipped))
        frames.append(flipped.withColumn("scenario", F.lit(s.name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def run_steps(df, steps: list[dict]):
    """A chain of ``{"func": f, "args": {...}}`` table functions.

    The first function may take a dict of frames; every later one takes a frame.
    """
    for step in steps:
        df = step["func"](df, **step.get("args", {}))
    return df


def apply_column_functions(df: DataFrame, meta: dict) -> DataFrame:
    """``{"column": {"preprocess": [f, ...]}}``: Column functions per column name."""
    changes = {}
    for c in df.columns:
        expr = F.col(c)
        for f in meta.get(c, {}).get("preprocess", []):
            expr = f(expr)
            changes[c] = expr
    return df.withColumns(changes) if changes else df


# Steps that stay right when all scenarios pass through together.
_WHOLE_STEPS = (aggregate.sum_over, project.scale)


def _all_at_once(step: dict) -> dict:
    args = dict(step.get("args", {}))
    if "group_cols" in args:
        args["group_cols"] = ["scenario", *args["group_cols"]]
    return {"func": step["func"], "args": args}


def read_result(spark: SparkSession, scenarios: list[Scenario], result: dict, meta: dict | None = None) -> DataFrame:
    """All scenarios of one catalogue result, after its step chain.

    ``result``: ``file`` or ``sources`` (several named tables), ``preprocess`` and
    ``index`` (densify over scenario + index).  Roll-up and scale chains run once over
    all scenarios in one scan; other chains see one scenario at a time.
    """
    steps = result.get("preprocess", [])
    if "sources" not in result and all(step["func"] in _WHOLE_STEPS for step in steps):
        df = run_steps(read_source(spark, scenarios, result), [_all_at_once(step) for step in steps])
        df = apply_column_functions(df, meta or {})
    else:
        frames = []
        for s in scenarios:
            if "sources" in result:
                data = {src["name"]: read_source(spark, [s], src).drop("scenario") for src in result["sources"]}
            else:
                data = read_source(spark, [s], result).drop("scenario")
            one = apply_column_functions(run_steps(data, steps), meta or {})
            frames.append(one.withColumn("scenario", F.lit(s.name)))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if result.get("index"):
        df = aggregate.densify(df, ["scenario", *result["index"]])
    return df


@dataclass(frozen=True)
class ViewSource:
    """A result ready for a view: its rows, column roles, and orders and colours of styled columns."""
    df: DataFrame
    roles: dict[str, list[str]]
    orders: dict[str, list]
    colors: dict[str, dict]


def load_view_source(result: DataFrame, meta: dict) -> ViewSource:
    """The chain from a loaded (and densified) result to a view, driven by column metadata.

    Per column, in order: ``join`` attributes of a lookup keyed by the column, ``map`` raw to display values, ``style``
    (order and colours); columns that a join adds go through the same.  Then types, roles and fills of missing values.
    """
    df, orders, colors, done = result, {}, {}, set()
    while todo := [c for c in df.columns if c not in done]:
        c = todo[0]
        done.add(c)
        one = meta.get(c, {})
        if "join" in one:
            df = joins.join_attributes(df, one["join"], c)
        if "map" in one:
            df = joins.map_values(df, c, one["map"])
        if "style" in one:
            orders[c], colors[c] = ranking.style_orders(one["style"])
    df = project.coerce_types(df, meta)
    roles = project.roles_from_meta(df, meta)
    return ViewSource(project.fill_by_role(df), roles, orders, colors)


class ResultStore:
    """Loaded results, kept as Parquet in a shared folder and extended run by run.

    A manifest names, for each result and run folder, the state of the files it was read from and the part written from
    them.  ``load`` compares states and reads only runs that are new or changed, all of them in one job; everything else
    comes from the parts.  Nothing lives on executors, so losing them costs nothing, and another session that names the
    same ``folder`` goes on from there.  A manifest replaces the one before it as a whole; one session writes at a time.
    Where a column is text in some runs only, it is text in the result.
    """

    def __init__(self, spark: SparkSession, catalog: dict, meta: dict | None = None, folder: str | None = None):
        self.spark, self.catalog, self.meta = spark, catalog, meta
        self.folder = (folder or new_folder(spark)).rstrip("/")

    def manifest(self) -> dict[str, dict[str, dict]]:
        """``{result: {run folder: {state, part, schema, kinds}}}``; kinds are the column types that the run has by itself."""
        try:
            return json.loads(self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).first()[0])
        except AnalysisException:
            return {}

    def _states(self, name: str, active: list[Scenario]) -> dict[str, str]:
        """State of each run: its files, its name and what is done with them."""
        result = self.catalog[name]
        sources = [src["file"] for src in result.get("sources", [result])]
        files = states_of(self.spark, [f"{s.path}/{OUTPUT_DIR}/{f}" for s in active for f in sources])
        work = json.dumps({k: v for k, v in result.items() if k != "index"}, sort_keys=True, default=lambda f: f"{f.__module__}.{f.__qualname__}")
        return {s.path: " ".join([*(files[f"{s.path}/{OUTPUT_DIR}/{f}"] for f in sources), s.name, hashlib.sha256(work.encode()).hexdigest()]) for s in active}

    def load(self, name: str, active: list[Scenario]) -> DataFrame:
        """The result for the active runs; only new and changed ones are read from their files."""
        manifest, now = self.manifest(), self._states(name, active)
        have = manifest.setdefault(name, {})
        self._write(name, manifest, now, [s for s in active if have.get(s.path, {}).get("state") != now[s.path]], ())
        # A column that is text in some runs is text in all, as if they had been read together.
        texts = sorted({c for s in active for c, t in have[s.path]["kinds"].items() if t == "string"})
        mixed = [s for s in active if any(f["name"] in texts and f["type"] != "string" for f in have[s.path]["schema"]["fields"])]
        if mixed and not self.catalog[name].get("preprocess") and "sources" not in self.catalog[name]:
            self._write(name, manifest, now, mixed, texts)
        df = self._parts([have[s.path] for s in active])
        index = self.catalog[name].get("index")
        return aggregate.densify(df, ["scenario", *index]) if index else df

    def _write(self, name: str, manifest: dict, now: dict, runs: list[Scenario], texts) -> None:
        """One job writes a part for each of the runs; the new manifest then takes the place of the old one."""
        if not runs:
            return
        have = manifest[name]
        result = {k: v for k, v in self.catalog[name].items() if k != "index"} | ({"texts": texts} if texts else {})
        df = read_result(self.spark, runs, result, self.meta)
        number = F.create_map(*[F.lit(v) for i, s in enumerate(runs) for v in (s.name, i)])
        target = f"{self.folder}/{uuid.uuid4().hex}"
        df.withColumn("__run", F.try_element_at(number, F.col("scenario"))).write.partitionBy("__run").parquet(target)
        old = [have[s.path]["part"] for s in runs if s.path in have]
        for i, s in enumerate(runs):
            schema = df.schema.jsonValue()
            kinds = have[s.path]["kinds"] if texts else {f["name"]: f["type"] for f in schema["fields"]}
            have[s.path] = {"state": now[s.path], "part": f"{target}/__run={i}", "schema": schema, "kinds": kinds}
        sinks.put_text(self.spark, f"{self.folder}/manifest.json", json.dumps(manifest))
        for part in old:
            fs, path = hadoop_path(self.spark, part)
            fs.delete(path, True)

    def _parts(self, entries: list[dict]) -> DataFrame:
        """One scan per schema; a column of several types becomes the widest, text above all."""
        kinds: dict[str, set] = {}
        groups: dict[str, list[dict]] = {}
        for e in entries:
            groups.setdefault(json.dumps([e["schema"], e["kinds"]]), []).append(e)
            for c, kind in e["kinds"].items():
                kinds.setdefault(c, set()).add(kind if isinstance(kind, str) else json.dumps(kind))
        wide = {c: k.copy().pop() if len(k) == 1 else "string" if k & {"string", "boolean", "date", "timestamp"} else "double" for c, k in kinds.items()}
        frames = []
        for same in groups.values():
            schema = StructType.fromJson(same[0]["schema"])
            there = [e["part"] for e in same if _exists(self.spark, e["part"])]  # a run without rows has no part
            df = self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)
            casts = {f.name: F.col(f.name).cast(wide[f.name]) for f in schema.fields if isinstance(f.dataType, AtomicType) and f.dataType.typeName() != wide[f.name] and not wide[f.name].startswith("{")}
            frames.append(df.withColumns(casts) if casts else df)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def clear(self) -> None:
        fs, path = hadoop_path(self.spark, self.folder)
        fs.delete(path, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)
