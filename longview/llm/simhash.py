"""Near duplicates by SimHash: an inverted index over byte positions with count filtering.

Two fingerprints of eight bytes that differ in at most k bits differ in at most k bytes, so they share at least 8 - k
bytes at equal positions. The index is keyed by the bytes at each choice of 8 - k positions: two fingerprints meet
under a key exactly if the tally of bytes they share reaches that minimum, and no pair below it is ever formed. What
meets differs in the k left-out bytes only. Members of a key are linked by looking their neighbours within k bits up,
and each group found is reported as a star, so rows grow with the members and not with their pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import written
from longview.llm.components import components

#: Fingerprints that one task puts under all their keys, at most on average.
INDEXED_AT_ONCE = 250_000


def simhash(text: str, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of the lower-cased (A-Z) words of a text; 0 without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    n, joined = max(1, len(words) - shingle + 1), b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    xx = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.array([xx(joined[a:b], 42) for a, b in spans], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        bits += np.unpackbits(hashes[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint of a text column; null counts as empty."""
    @F.pandas_udf("long")
    def f(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return f(F.coalesce(text, F.lit("")))


def _left_out(bits: int) -> list[tuple[int, ...]]:
    return list(combinations(range(8), bits))


def _mask(positions: tuple[int, ...]) -> int:
    m = (1 << 64) - 1 - sum(255 << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _stars(members: np.ndarray, positions: tuple[int, ...], bits: int) -> list[tuple[int, int]]:
    """(member, smallest member of its group) for distinct members that differ at ``positions`` only."""
    members = np.sort(members)
    k = len(members)
    if k <= 8:
        values, root = members.tolist(), list(range(k))
        for i, j in combinations(range(k), 2):
            if ((values[i] ^ values[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
        return [(values[i], values[r]) for i, r in enumerate(root) if i != r]
    rest = np.zeros(k, dtype=np.int64)
    for i, p in enumerate(positions):
        rest |= ((members >> (8 * p)) & 255) << (8 * i)
    width = 8 * len(positions)
    masks = np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(width), n)], dtype=np.int64)
    order = np.argsort(rest)
    known = rest[order]
    at = np.searchsorted(known, rest[:, None] ^ masks[None, :]).clip(max=k - 1)
    near = np.where(known[at] == (rest[:, None] ^ masks[None, :]), order[at], np.arange(k)[:, None])
    root = np.arange(k)
    while True:
        new = root[near].min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return [(int(members[i]), int(members[r])) for i, r in enumerate(root) if i != r]


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp, best written before) such that what is within ``bits`` bits is connected."""
    if not 0 <= bits <= 3:
        raise ValueError("0 to 3 bits")
    choices = _left_out(bits)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(c))) for c in choices])
    # Each fingerprint becomes as many rows as there are keys, so tasks sized by what they read would be far too few.
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // INDEXED_AT_ONCE))
    index = prints.select("fp").repartition(tasks, "fp").select("fp", F.posexplode(keys).alias("choice", "shared"))
    met = index.groupBy("choice", "shared").agg(F.collect_list("fp").alias("members")).filter("size(members) > 1").select("choice", "members")

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def star(choice: pd.Series, members: pd.Series) -> pd.Series:
        return pd.Series([[{"u": u, "v": v} for u, v in _stars(m, choices[c], bits)] for c, m in zip(choice, members)])

    return met.select(F.explode(star("choice", "members")).alias("l")).select("l.u", "l.v").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp (signed 64-bit fingerprint), component_id (smallest id reachable).

    Fingerprints are linked at ``bits`` or fewer differing bits, whatever the texts. Null and empty texts have
    fingerprint 0, which is linked like any other. Equal texts have equal fingerprints and are one node; rows with a
    null id take part and get the smallest id of their component (null if it has none). Repeated rows each come back.
    An empty table gives an empty result. The texts are read once and are not shuffled.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    return rows.join(_labels(rows, bits), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _labels(rows: DataFrame, bits: int, *more: str) -> DataFrame:
    """(fp, component_id, ...) of each fingerprint of ``rows`` (id, fp); ``root`` is another column to ask for."""
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("id")))
    stars = components(links(nodes, bits)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = written(nodes.join(stars, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")))
    least = written(nodes.groupBy("root").agg(F.min("id").alias("component_id")))
    return written(nodes.join(least, "root").select("fp", "component_id", *more))


def one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null ids last.

    Of a component's rows with that id the longest text stays, then the smallest hash of the row; of rows that agree in
    all columns one stays. An id that occurs in several components stands for a row in each of them. Null and empty texts
    are a component like any other. All columns come back, whatever their names; an empty table gives no rows.
    """
    whole = F.xxhash64(*docs.columns).alias("hash")
    rows = written(docs.select(F.col("doc_id").alias("id"), fingerprint(F.col("text"), shingle).alias("fp"), F.length("text").alias("size"), whole))
    first = F.min(F.struct(F.isnull("id").alias("none"), "id", (-F.coalesce("size", F.lit(0))).alias("size"), "hash")).alias("first")
    stay = rows.join(_labels(rows, bits, "root"), "fp").groupBy("root").agg(first)
    stay = written(stay.select(F.col("first.id").alias("stays"), F.col("first.hash").alias("same")).distinct())
    both = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), whole)
    kept = both.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("hash") == F.col("same")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
