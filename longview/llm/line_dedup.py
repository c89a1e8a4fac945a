"""Removal of boilerplate lines by the number of distinct sites that show them.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation. Estimates far from the threshold
decide at once; lines near it get their exact number of distinct sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import SPACE, written

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch, and how far (as a share) an estimate may be off to be trusted. The standard error
#: of 2**10 registers is 3.3 %, so 20 % is six of them.
REGISTERS, MARGIN = 10, 0.2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> list[Column]:
    """128 bits of a line without the white space around it."""
    bare = F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")]


def occurrences(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a character that isn't white space: id, text hash, position, line hash (h1, h2), site."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(site_col).alias("site"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", "text_hash", "site", "pos", *_key(F.col("line")))


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, sites, estimate) of each line of ``lines`` that at least ``min_sites`` distinct sites show.

    ``sites`` is exact for estimates near the threshold and null for those well above it. A null site is one site.
    """
    named = lines.select("h1", "h2", F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("")).alias("site"))
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("estimate")
    spread = written(named.groupBy("h1", "h2").agg(estimate).filter(F.col("estimate") >= min_sites * (1 - MARGIN)))
    sure = spread.filter(F.col("estimate") > min_sites * (1 + MARGIN)).select("h1", "h2", F.lit(None).cast("long").alias("sites"), "estimate")
    near = written(spread.filter(F.col("estimate") <= min_sites * (1 + MARGIN)))
    pairs = written(named.join(near, ["h1", "h2"]))  # written first: the join may then split a line that is everywhere
    pairs = pairs.groupBy("h1", "h2", "site").agg(F.first("estimate").alias("estimate"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites"), F.first("estimate").alias("estimate")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines taken out of its texts, and a column lines_removed.

    A line is compared without the white space around it; lines of white space alone are left. A line that ``min_sites``
    distinct sites show goes from all texts but one: with ``keep_first`` its first occurrence by id, text and position
    stays, so that what whole copies share is not lost altogether. Null texts stay null; a null site is a site and null
    ids come first. Rows that agree in id and text are treated alike. All rows and columns come back (a column
    lines_removed is replaced; names from two underscores on are reserved), an empty table gives an empty result; texts that lose all their lines come back empty.

    Shuffled are line hashes with sites (merged to sketches before), positions of lines that go, and once the texts, to
    meet those positions.
    """
    lines = written(occurrences(docs, site_col, id_col, text_col))
    found = written(line_spread(lines, min_sites).select("h1", "h2"))
    # Written before anything else needs its key together, so that the join may split a line that is everywhere.
    hits = written(lines.join(found, ["h1", "h2"]).select("h1", "h2", "id", "text_hash", "pos"))
    if keep_first:
        first = written(hits.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash", "pos")).alias("first")))
        hits = hits.join(first, ["h1", "h2"]).filter(~F.struct("id", "text_hash", "pos").eqNullSafe(F.col("first")))
    gone = written(hits.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("_gone")))
    gone = gone.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("_gone").alias("__gone"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    rows = docs.join(gone, same, "left")
    rest = F.array_join(F.filter(_lines(F.col(text_col)), lambda line, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    text = F.when(F.isnull("__gone"), F.col(text_col)).otherwise(rest)
    removed = F.greatest(F.size("__gone"), F.lit(0)).cast("long").alias("lines_removed")
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "lines_removed"], removed)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "text", "lines_removed")


SQL = r"""
WITH l AS (SELECT doc_id, source, pos, string_split(text, chr(10))[pos] AS raw FROM
           (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)),
b AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
w AS (SELECT line FROM b WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT b.*, w.line IS NOT NULL AND row_number() OVER (PARTITION BY b.line ORDER BY doc_id, pos) > 1 AS gone
      FROM b LEFT JOIN w ON b.line = w.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS lines_removed
FROM m GROUP BY doc_id
"""
