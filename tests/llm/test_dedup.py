"""Exact, line and near duplicates against brute force, and their edge cases."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from longview.llm import exact_dedup, line_dedup, queries, simhash
from longview.llm.components import components
from tests.conftest import SF
from tools.check import rows_of

ODD = [(1, "a b\nc"), (2, "ab c"), (3, "abc "), (3, "abc "), (4, None), (5, ""), (6, " \n"), (None, "abc"), (7, "x" * 200_000), (8, "x" * 200_000 + " "), (9, "y")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    res = con.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(res.fetchall(), names)


def test_exact_edges(frame):
    got = sorted(map(tuple, exact_dedup.exact_groups(frame(ODD)).collect()), key=str)
    by = defaultdict(list)
    for doc_id, keep, n, kept in got:
        by[keep, n].append((doc_id, kept))
    # "a b\nc" has the most code points; the null text counts as empty, " \n" is the longest empty one.
    assert sorted(by[1, 5], key=str) == [(1, True), (2, False), (3, False), (3, False), (None, False)]
    assert sorted(by[6, 3]) == [(4, False), (5, False), (6, True)]
    assert sorted(by[8, 2]) == [(7, False), (8, True)] and by[9, 1] == [(9, True)]


def test_exact_repeated_rows_keep_one(frame):
    got = exact_dedup.exact_groups(frame([(5, "same")] * 4)).collect()
    assert [r.group_size for r in got] == [4] * 4 and sum(r.kept for r in got) == 1
    assert exact_dedup.exact_groups(frame([])).collect() == []


def test_line_edges(frame):
    rows = [(i, f"own {i}\n  shared line \n\nshared line", "en", f"s{i}") for i in range(12)]
    rows += [(20, None, "en", None), (21, "", "en", None), (22, "shared line", "en", None), (22, "shared line", "en", None), (None, "other", "en", "s1")]
    out = {(r.doc_id, r.text, r.lines_removed) for r in line_dedup.without_boilerplate(frame(rows), 10).collect()}
    assert (0, "own 0\n  shared line \n", 1) in out  # the first occurrence stays
    assert (5, "own 5\n", 2) in out and (22, "", 1) in out
    assert (20, None, 0) in out and (21, "", 0) in out and (None, "other", 0) in out
    assert line_dedup.without_boilerplate(frame([])).collect() == []


def test_line_spread_near_threshold_is_exact(frame):
    rows = [(s * 100 + n, f"line of {n} sites", "en", f"s{s}") for n in range(1, 25) for s in range(n)]
    found = line_dedup.line_spread(line_dedup.occurrences(frame(rows)), 10).collect()
    assert len(found) == 15 and {r.sites for r in found if r.sites} == {10, 11, 12}


def brute(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, bits):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i)
    return {i: least[r] for i, r in zip(ids, root)}


def test_simhash_brute_force(spark, documents):
    got = queries.QUERIES["op8_simhash"](spark, SF).collect()
    rows = documents.select("doc_id", "text").collect()
    prints = {r.doc_id: brute(r.text) for r in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == groups(list(prints), list(prints.values()), 2)


def test_simhash_edges(frame):
    rows = [(1, "Ab c"), (2, "aB  C"), (2, "aB  C"), (3, None), (4, ""), (5, "É é é"), (None, "ab c"), (6, "one")]
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(frame(rows)).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert {(1, signed(brute("ab c")), 1), (2, signed(brute("ab c")), 1), (None, signed(brute("ab c")), 1), (3, 0, 3), (4, 0, 3), (6, signed(brute("one")), 6)} <= got
    kept = simhash.one_of_each(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6] and kept.columns == frame(rows).columns
    assert simhash.near_groups(frame([])).collect() == []


def test_stars_connect_a_large_bucket(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {base}
    for _ in range(400):
        prints.add(base ^ (1 << int(rng.integers(30))) ^ (1 << int(rng.integers(30))) ^ (1 << int(rng.integers(30))))
    prints |= {int(x) for x in rng.integers(1 << 62, size=100)}
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.links(nodes)
    assert links.count() < 28 * len(prints)
    got = {r.u: r.v for r in components(links).collect()}
    want = groups(sorted(prints), sorted(prints), 2)
    assert {p: got.get(p, p) for p in prints} == want


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(300, 360)] + [(5, 5)]
    got = {r.u: r.v for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 131)} | {i: 7 for i in range(300, 360)}


def test_one_of_each_with_repeated_and_missing_ids(spark, frame):
    a, b, c = ("alpha beta gamma delta " * 5, "one two three four five " * 5, "red green blue cyan " * 5)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    # One id over several components: each of them keeps a row.
    assert rows(simhash.one_of_each(frame([(1, a), (2, b), (3, c), (3, b)]))) == [(1, a), (2, b), (3, c)]
    assert rows(simhash.one_of_each(frame([(1, a), (1, b), (1, a)]))) == [(1, a), (1, b)]
    # A row without an id stays only where its component has none.
    assert rows(simhash.one_of_each(frame([(1, a), (None, a), (None, b), (None, b)]))) == [(1, a), (None, b)]
    got = simhash.one_of_each(frame([(4, a), (5, None), (6, ""), (7, " ")]).withColumnsRenamed({"size": "hash", "row": "root", "key": "first", "rank": "same", "n": "__id"}))
    assert rows(got) == [(4, a), (5, None)] and {"hash", "root", "first", "same", "__id"} <= set(got.columns)
