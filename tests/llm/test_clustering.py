"""Centroid clustering against the plain computation over all vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from longview.llm import clustering
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, cells string, vector string, cluster string, distance string, id string"


def plain(rows, k, rounds, width):
    """Every vector against every centroid in Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), a in zip(kept, at) if a == c]
                centroids[c] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[c]
    away = [far(v, centroids[a]) for (_, v), a in zip(kept, at)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, a, d, sum(x for x, b in zip(away, at) if b == a), sum(away), digest[a]) for (i, _), a, d in zip(kept, at, away)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *"abcde") for i, v in rows], KIND)


def test_clusters_equal_the_plain_computation(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 3 * (i % 3)).tolist()) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]  # one vector many times
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1])]  # repeated and missing ids
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 5 + [None]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [1.0] * 7)]
    for bits in (1, 4, 8):
        got = clustering.clusters(frame(spark, rows), 5, 4, width=6, bits=bits)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 5, 4, 6)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(12)]  # equal centroids from the start
    got = clustering.clusters(frame(spark, rows), 4, 3, width=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 4, 3, 4)


def test_few_or_no_vectors(spark):
    one = frame(spark, [(1, [0.5, -0.5])])
    assert [tuple(r)[:5] for r in clustering.clusters(one, 8, 2, width=2).collect()] == [(1, 0, 0, 0, 0)]
    for rows in ([], [(1, None), (2, [1.0])]):
        none = clustering.clusters(frame(spark, rows), width=2)
        assert none.collect() == [] and none.columns == clustering.clusters(one, width=2).columns
    with pytest.raises(Exception, match="fit a long"):
        clustering.clusters(frame(spark, [(1, [3e5, 0.0])]), width=2).collect()


def test_intervals_hold_the_distance_and_decide_most_vectors():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(4000, 64)) * 130 + rng.integers(0, 8, 4000)[:, None] * 40).astype(np.int64)
    centroids = vectors[:8].copy()
    near = clustering.Nearest(centroids, None).exact(vectors)
    centroids = np.array([vectors[near == c].sum(axis=0) // max(1, (near == c).sum()) for c in range(8)])
    shares = []
    for bits in (3, 5, 8):
        cells = clustering.Cells(vectors[:1024], bits)
        cells.bound(vectors.min(axis=0), vectors.max(axis=0))
        by_cells = clustering.Nearest(centroids, cells)
        cluster, sure = by_cells.by_cells(cells.number(vectors))
        want = by_cells.exact(vectors)
        assert (cluster[sure] == want[sure]).all()
        fetched = []
        assert (by_cells(cells.number(vectors), lambda rows: fetched.append(len(rows)) or vectors[rows]) == want).all()
        assert sum(fetched) == (~sure).sum()  # nothing else is decoded
        shares.append(sure.mean())
    assert shares == sorted(shares) and shares[-1] > 0.5


def test_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in vectors.select("vec_id", "embedding").collect()]
    got = clustering.op12_centroid_clustering(spark, SF).withColumn("cluster", F.col("cluster").cast("long"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 8, 10, 64)
