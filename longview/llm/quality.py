"""Quality rules as robust multivariate outliers: minimum covariance determinant per language and source.

Each text is a vector of transformed statistics. Within a group, concentration steps look for the three quarters of the
texts with the tightest scatter, and a text is rejected by its Mahalanobis distance from their centre. A step is one
aggregation: distances fall into fine bins of their logarithm, a group's moments are summed per bin, and the bins up
to the quantile add up to the next centre and scatter. Vectors are whole numbers (1/1024 units), so sums are exact and
do not depend on partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.llm.common import written

BLANKS, SIGNS = " \t\n\v\f\r", "#*$%&|<>"
UNIT, BINS = 1024, 64
FEATURES = ("length", "signs", "lines", "repeats")
#: Standard deviation below which a statistic is taken as constant, by feature: the least spread that matters.
LEAST = (0.05, 0.10, 0.20, 0.20)
#: Share of a group that the estimate rests on, the factor that makes it consistent for normal vectors of four
#: statistics, and the quantile 0.9999 of the chi-squared distribution of four degrees.
SHARE, FACTOR, CUT = 0.75, 1.485, 23.51
#: Smaller groups are pooled: sources of a language, then languages.
LEAST_ROWS = 100
STEPS = 8
#: Parts that the rows of a group are dealt into when its estimate joins them.
SALTS = 32


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), chars, sum(map(text.count, SIGNS)), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur at least twice."""
    n = len(words) - window + 1
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if n < 2 or len(number) == len(words):
        return 0
    ids = np.array(ids, dtype=np.uint64)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n] + np.uint64(1)
    _, group, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[group] > 1)
    if not len(at):
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)[at]
    _, group, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[group.ravel()] > 1]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts], columns=COUNTS, dtype="int64")


def _vector() -> dict[str, Column]:
    """Whole-number features. Short texts are drawn towards plain ones, as their ratios say little."""
    n = F.col("n_words")
    root = lambda c, per: F.sqrt(c * per / (n + 20.0))
    raw = (F.log((F.col("word_chars") + 200.0) / (n + 40.0)), root(F.col("n_symbols"), 1.0), root(F.col("n_dup_lines"), 10.0), root(F.col("n_repeat_words"), 1.0))
    return {f: F.round(c * UNIT).cast("long") for f, c in zip(FEATURES, raw)}


def _pooled(rows: DataFrame) -> DataFrame:
    """``rows`` with the id of their group: language and source, else language, else all that is left."""
    mark = lambda level, *cols: F.xxhash64(F.lit(level), *[x for c in cols for x in (F.isnull(c), F.col(c))])
    rows = rows.withColumn("grp", mark(2, "lang", "source"))
    for level, cols in ((1, ("lang",)), (0, ())):
        sizes = written(rows.groupBy("grp").agg(F.count("*").alias("_n")).filter(F.col("_n") < LEAST_ROWS))
        rows = rows.join(sizes, "grp", "left").withColumn("grp", F.when(F.isnull("_n"), F.col("grp")).otherwise(mark(level, *cols))).drop("_n")
    return rows


def _met(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` beside the estimate of their group, with every group's rows dealt over SALTS parts."""
    return rows.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "salt"])


def _middle(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Median of each value per group, from exact counts in bins of 1/BINS."""
    long = rows.select("grp", F.explode(F.create_map(*[x for f, v in values.items() for x in (F.lit(f), F.floor(v * BINS / UNIT))])).alias("f", "bin"))
    counts = long.groupBy("grp", "f", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp", "f")
    up_to = counts.withColumn("to", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    middle = up_to.filter(2 * F.col("to") >= F.col("all")).groupBy("grp", "f").agg((F.min("bin") * UNIT / BINS + UNIT / BINS / 2).alias("m"))
    return middle.groupBy("grp").agg(*[F.max(F.when(F.col("f") == f, F.col("m"))).alias(f"m_{f}") for f in values])


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _roots(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor (l_i_j) of each group's scatter (s_i_j)."""
    for i, j in PAIRS:
        rest = F.col(f"s_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return params.select("grp", *[f"m_{f}" for f in FEATURES], *[f"l_{i}_{j}" for i, j in PAIRS])


def _distance(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance, by forward substitution."""
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m_{f}") - sum((F.col(f"l_{i}_{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"_z{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("distance", sum(F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(FEATURES))))


def _least(i: int) -> float:
    return (LEAST[i] * UNIT) ** 2


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and scatter from the medians of the absolute deviations."""
    centre = written(_middle(rows, {f: F.col(f) for f in FEATURES}))
    off = _middle(_met(rows, centre), {f: F.abs(F.col(f) - F.col(f"m_{f}")) for f in FEATURES})
    off = off.select("grp", *[F.col(f"m_{f}").alias(f"a_{f}") for f in FEATURES])
    params = centre.join(off, "grp")
    for i, j in PAIRS:
        params = params.withColumn(f"s_{i}_{j}", F.pow(F.col(f"a_{FEATURES[i]}") * 1.4826, 2) + _least(i) if i == j else F.lit(0.0))
    return written(_roots(params))


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step."""
    bin_ = F.floor(F.log2(F.col("distance") + 1e-6) * BINS).alias("bin")
    moments = [F.sum(f).alias(f"x_{f}") for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"xx_{i}_{j}") for i, j in PAIRS]
    bins = _distance(_met(rows, params)).groupBy("grp", bin_).agg(F.count("*").alias("n"), *moments)
    w = Window.partitionBy("grp")
    bins = bins.withColumn("_below", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("_all", F.sum("n").over(w))
    half = bins.filter(F.col("_below") < F.ceil(F.col("_all") * SHARE))
    sums = half.groupBy("grp").agg(*[F.sum(c).alias(c) for c in ["n", *[f"x_{f}" for f in FEATURES], *[f"xx_{i}_{j}" for i, j in PAIRS]]])
    out = sums.select("grp", "n", *[(F.col(f"x_{f}") / F.col("n")).alias(f"m_{f}") for f in FEATURES], *[f"xx_{i}_{j}" for i, j in PAIRS])
    for i, j in PAIRS:
        cov = F.col(f"xx_{i}_{j}") / F.col("n") - F.col(f"m_{FEATURES[i]}") * F.col(f"m_{FEATURES[j]}")
        out = out.withColumn(f"s_{i}_{j}", FACTOR * cov + (_least(i) if i == j else 0.0))
    return written(_roots(out))


def _same(a: DataFrame, b: DataFrame) -> bool:
    both = a.join(b.select("grp", *[F.col(c).alias(f"_{c}") for c in b.columns if c != "grp"]), "grp")
    far = [F.abs(F.col(c) - F.col(f"_{c}")) > 1e-6 for c in a.columns if c != "grp"]
    return both.filter(F.expr("false") if not far else _any(far)).isEmpty()


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, the statistics, base_failed, distance, kept.

    base_failed: fewer than 20 words, or over 30 % of the words inside eight-word windows that repeat. What fails that
    is rejected, has no distance and takes no part in the estimates. Null texts count as empty; null languages and
    sources are groups like any other; groups under ``LEAST_ROWS`` rows are pooled. Repeated rows count and come back
    each. An empty table gives an empty result.

    Texts are read once; what is shuffled are sums per group and bin. Estimates rest on all rows.
    """
    s = _statistics(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), s.alias("s")).select("id", "lang", "source", "s.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed))
    sound = _pooled(rows.filter(~F.col("base_failed")).withColumns(_vector()))
    sound = written(sound.withColumn("salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")))
    narrow = sound.select("grp", "salt", *FEATURES)
    params = _start(narrow)
    for _ in range(STEPS):
        before, params = params, _step(narrow, params)
        if _same(params, before):
            break
    judged = _distance(_met(sound, params)).withColumn("kept", F.col("distance") <= CUT)
    columns = ["id", *COUNTS, "base_failed"]
    out = judged.select(*columns, "distance", "kept").union(
        rows.filter("base_failed").select(*columns, F.lit(None).cast("double"), F.lit(False)))
    return out.withColumnRenamed("id", id_col)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
