"""Centroid clustering on a vector approximation file.

Every vector is kept beside a few bits per component: the number of the cell that the component lies in, and the exact
squared length of the vector. For a centroid c the distance of a vector x is |x|^2 + sum of c_d * (c_d - 2 * x_d), and a
cell bounds x_d from both sides, so one table per component gives the least and the most that its cell adds for each
centroid. The sums are an interval of the distance. Where one centroid's interval lies below all others it is the
nearest; only where intervals overlap the full vector is decoded and compared. A round moves the sums of the vectors
that changed their cluster, so those whose cluster stays need not be decoded either.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.llm.common import written

#: Bits of a cell number and vectors (those of the smallest hashes) whose quantiles bound the cells. Cells decide how many
#: vectors are decoded, never a result.
BITS, DRAWN = 8, 1024
#: Components stay below this size, so that every squared distance is a long.
LARGEST = 2**17


class Cells:
    """Bounds of the cells of every component."""

    def __init__(self, drawn: np.ndarray, bits: int):
        share = np.arange(1, 2**bits) / 2**bits
        self.edges = np.quantile(drawn, share, axis=0, method="nearest").astype(np.int64).T
        self.low = self.high = None

    def bound(self, least: np.ndarray, most: np.ndarray) -> None:
        """Closes the outer cells at the least and the largest value of each component."""
        self.low = np.hstack([least[:, None], self.edges])
        self.high = np.hstack([self.edges - 1, most[:, None]])

    def number(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, vectors[:, d], side="right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)


class Nearest:
    """Nearest centroid of vectors, by cells as far as they tell; a tie goes to the smaller number."""

    def __init__(self, centroids: np.ndarray, cells: Cells | None):
        self.centroids, self.k = centroids, len(centroids)
        self.square = (centroids * centroids).sum(axis=1)
        self.table = None
        if cells is not None and cells.low is not None:
            c = centroids.T[:, None, :]
            ends = [c * (c - 2 * x[:, :, None]) for x in (cells.low, cells.high)]
            self.table = np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)

    def by_cells(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, whether no other interval reaches it)."""
        if self.table is None:
            return np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
        span = np.zeros((len(numbers), 2 * self.k), np.int64)
        for d, t in enumerate(self.table):
            span += t[numbers[:, d]]
        near = span[:, :self.k] <= span[:, self.k:].min(axis=1)[:, None]
        return near.argmax(axis=1), near.sum(axis=1) == 1

    def exact(self, vectors: np.ndarray) -> np.ndarray:
        return (self.square - 2 * (vectors @ self.centroids.T)).argmin(axis=1)

    def __call__(self, numbers: np.ndarray, fetch) -> np.ndarray:
        """Clusters of all rows; ``fetch`` decodes the vectors of the rows given to it."""
        cluster, sure = self.by_cells(numbers)
        open_ = np.flatnonzero(~sure)
        if len(open_):
            cluster[open_] = self.exact(fetch(open_))
        return cluster


def _whole(batch: pa.RecordBatch, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose vector is complete and finite, and those vectors as integers."""
    lists = batch.column(1)
    size = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == width)
    flat = lists.take(pa.array(rows)).flatten()
    values = np.asarray(flat.fill_null(float("nan"))).astype(np.float64).reshape(-1, width)
    fine = np.isfinite(values).all(axis=1)
    rows, values = rows[fine], np.floor(values[fine] * scale)
    if values.size and np.abs(values).max() >= LARGEST * scale:
        raise ValueError(f"components of {LARGEST} or more: their squared distances don't fit a long")
    return rows, values.astype(np.int64)


def _decoded(column: pa.Array, kind: str, width: int, rows: np.ndarray | None = None) -> np.ndarray:
    column = column if rows is None else column.take(pa.array(rows))
    raw = b"".join(x.as_py() for x in column) if len(column) else b""
    return np.frombuffer(raw, dtype=kind).reshape(-1, width)


def _encoded(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def _tally(store: DataFrame, now: Nearest, before: Nearest | None, width: int) -> list:
    """Per cluster and component what the sums and counts (component ``width``) change by from one assignment to the
    next; without ``before`` also the least and largest value of each component, as cluster -1."""

    def count(batches):
        k, fetched = now.k, 0
        sums = np.zeros((k, width + 1), np.int64)
        least, most = np.full(width, 2**62), np.full(width, -2**62)
        for batch in batches:
            numbers = _decoded(batch.column(0), "u1", width)
            fetch = lambda rows, b=batch: _decoded(b.column(1), "<i4", width, rows).astype(np.int64)
            new = now(numbers, fetch)
            old = np.full(len(new), -1) if before is None else before(numbers, fetch)
            moved = np.flatnonzero(new != old)
            vectors = fetch(moved)
            vectors = np.hstack([vectors, np.ones((len(moved), 1), np.int64)])
            np.add.at(sums, new[moved], vectors)
            if before is not None:
                np.subtract.at(sums, old[moved], vectors)
            elif len(moved):
                least, most = np.minimum(least, vectors[:, :width].min(axis=0)), np.maximum(most, vectors[:, :width].max(axis=0))
            fetched += len(moved)
        at = [(c, d, int(sums[c, d]), 0, 0) for c in range(k) for d in range(width + 1) if sums[c, d]]
        at += [(-1, d, 0, int(least[d]), int(most[d])) for d in range(width) if before is None and fetched]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*at)] if at else [pa.array([], pa.int64())] * 5,
                                         names=["cluster", "dim", "total", "least", "most"])

    rows = store.select("cells", "vector").mapInArrow(count, "cluster long, dim long, total long, least long, most long")
    return rows.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                              F.min("least").alias("least"), F.max("most").alias("most")).collect()  # (k + 1) * (width + 1) rows


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: float = 1024.0,
             bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``width`` components, none null or not finite; a component x counts as floor(scale * x).
    Centroids start as the ``k`` kept vectors with the smallest sha256 of ``<seed>:<id>`` (equal ids by the bytes of their
    vectors, null ids last); fewer kept vectors make fewer centroids. A round assigns every vector to the nearest centroid
    (equal distances: the smaller number) and moves each centroid that has vectors to their floored mean; centroids
    without vectors stay. Distances are squared, sums exact. Rows with equal ids or vectors each count and come back; null
    vectors are not kept; an empty table, or one without a kept vector, gives no rows. Other columns are not looked at.
    Components of ``LARGEST`` or more raise an error, since squared distances would not fit their column.

    The driver holds centroids, cell bounds and their sums only: their size depends on ``k`` and ``width``. A round is one
    pass over the written vectors; nothing is shuffled but one row per task, cluster and component.
    """
    if not 1 <= bits <= 8:
        raise ValueError("1 to 8 bits a cell")
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = source.schema["id"].dataType.simpleString()

    def whole(batches):
        for batch in batches:
            rows, values = _whole(batch, width, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _encoded(values.astype("<i4"))], names=["id", "vector"])

    kept = written(source.mapInArrow(whole, f"id {kind}, vector binary"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    drawn = kept.orderBy(order.asc_nulls_last(), "vector").limit(max(k, DRAWN)).select("vector").collect()
    if not drawn:
        return kept.selectExpr(f"id AS `{id_col}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    drawn = np.frombuffer(b"".join(r[0] for r in drawn), dtype="<i4").reshape(-1, width).astype(np.int64)
    cells, centroids = Cells(drawn, bits), drawn[:k].copy()

    def approximate(batches):
        for batch in batches:
            numbers = cells.number(_decoded(batch.column(1), "<i4", width))
            yield pa.RecordBatch.from_arrays([*batch.columns, _encoded(numbers)], names=["id", "vector", "cells"])

    store = written(kept.mapInArrow(approximate, f"id {kind}, vector binary, cells binary"))
    sums, before = [[0] * (width + 1) for _ in centroids], None
    for _ in range(rounds):
        now = Nearest(centroids, cells)
        found = _tally(store, now, before, width)
        for r in found:
            if r["cluster"] >= 0:
                sums[r["cluster"]][r["dim"]] += int(r["total"])
        if before is None:
            span = sorted((r["dim"], r["least"], r["most"]) for r in found if r["cluster"] < 0)
            cells.bound(np.array([x[1] for x in span]), np.array([x[2] for x in span]))
        before = now
        centroids = np.array([[s // row[width] for s in row[:width]] if row[width] else old.tolist() for row, old in zip(sums, centroids)], dtype=np.int64)
    last = Nearest(centroids, cells)

    def assign(batches):
        for batch in batches:
            values = _decoded(batch.column(1), "<i4", width).astype(np.int64)
            cluster = last(_decoded(batch.column(2), "u1", width), lambda rows, v=values: v[rows])
            away = values - last.centroids[cluster]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array((away * away).sum(axis=1))], names=["id", "cluster", "distance"])

    out = written(store.mapInArrow(assign, f"id {kind}, cluster int, distance long"))
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    return out.select(F.col("id").alias(id_col), "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"),
                      F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(F.array(*map(F.lit, digest)), F.col("cluster")).alias("centroid_sha256"))


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    away = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS k, q FROM v
 QUALIFY k < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT v.r, arg_min(c.k, {away} * 1000 + c.k) AS k, CAST(min({away}) AS BIGINT) AS away
 FROM v, c{i} c GROUP BY v.r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n FROM
 (SELECT a.k, unnest(v.q) AS x, unnest(range(64)) AS d FROM v JOIN a{i} a ON a.r = v.r) GROUP BY k, d),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY d) AS q FROM s{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.k AS cluster, a.away AS distance, CAST(sum(a.away) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.away) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} c ON c.k = a.k"""


SQL = _sql()
