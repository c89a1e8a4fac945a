"""The pipeline's stages on a small corpus with known copies, boilerplate and insults."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF


def test_whole_pipeline(spark):
    """Brute force over the stages' own results: what each keeps follows from what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append(out)
        assert name == "packing" or out.columns == columns
    ids = [[r[0] for r in d.select("doc_id").collect()] for d in seen]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(set(ids[1]) & toxic) <= 0.35 * len(set(ids[0]) & toxic) and len(ids[1]) >= len(ids[0]) - 1.1 * len(toxic) - 30
    assert ids[1] and sorted(ids[2]) == sorted(ids[1])
    assert set(ids[3]) < set(ids[2]) and len(ids[3]) == len(set(ids[3]))
    assert set(ids[4]) <= set(ids[3]) and set(ids[5]) == set(ids[4])
    assert max(r.offset + r.length for r in seen[5].collect()) <= 1024
    assert sum(r.start == 0 for r in seen[5].collect()) == len(ids[4])


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, frame, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rnd = random.Random(1)
    text = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(30))
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(20)] + [(30, None, None, None), (31, "", "en", "s1"), (None, text(), "en", "s1"), (32, "w " * 50_000, "en", "s1")]
    rows += [(5, *rows[5][1:]), (33, rows[5][1], "en", "s2")]
    docs = frame(rows).withColumn("text2", F.col("text"))
    out = stage(spark, docs, SF)
    got = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
    if name in ("toxicity", "line_dedup"):
        assert len(got) == len(rows)
    if name == "simhash":
        # The null and the empty text are one component, equal texts another; the smallest id stays.
        assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [*range(20), 30, 32, None]))
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_mixing_with_names_that_it_uses_itself(spark, frame):
    docs = frame([(i % 7, f"w{i} " * (i + 1), "en", f"s{i % 3}") for i in range(30)] + [(3, "same", "en", "s0")] * 3)
    docs = docs.withColumnsRenamed({"row": "doc", "key": "hash", "n": "words", "size": "number", "rank": "h", "bits": "__hash", "word": "__copy"})
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF)
    assert out.columns == docs.columns and out.count() > 0
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
