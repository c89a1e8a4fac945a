"""The n-gram Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from longview.llm import jaccard
from tests.conftest import SF


def shingles(text, size=4):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, percent=85, size=4):
    """Components by all pairs of sets."""
    sets = [shingles(t, size) for _, t in rows]
    at = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and at[i] != at[j]:
            at = [at[i] if x == at[j] else x for x in at]
    least = {c: min((r[0] for r, x in zip(rows, at) if x == c and r[0] is not None), default=None) for c in set(at)}
    return sorted(((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, at)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        yield " ".join(text)


def sample(seed, groups=6, copies=9, edits=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [t for _ in range(groups) for t in near_copies(rng, words, copies, edits)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts += [" ".join(rng.choice(words[:6]) for _ in range(n % 14)) for n in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("slack,hot", [(4, 50), (1, 2)])  # the second makes most keys hot
def test_components_equal_all_pairs(spark, frame, slack, hot):
    rows = sample(1) + [(900, None), (901, ""), (902, " \n\t "), (903, "One two"), (904, "one  TWO"), (905, "one two three"), (None, "one two"),
                        (None, "alone here"), (3, "x y z u v w"), (3, "x y z u v w"), (907, "É b c d"), (908, "é b c d")]
    got = jaccard.jaccard_components(frame(rows), slack=slack, hot=hot)
    assert found(got) == plain(rows)


def test_deletion_neighbourhoods_find_what_hot_keys_hid(spark, frame):
    # Most of each text is common to all, so that many parts are hot; some edits leave a pair just within the threshold.
    rng = random.Random(4)
    words, tail, rows = [f"v{i}" for i in range(900)], " ".join(f"t{i}" for i in range(45)), []
    for _ in range(300):
        base = [rng.choice(words) for _ in range(rng.randint(25, 45))]
        for _ in range(2):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), tail + " " + " ".join(text)))
    assert found(jaccard.jaccard_components(frame(rows), slack=0, hot=20)) == plain(rows)
    join = jaccard.Join(*jaccard.shingle_sets(frame(rows), 4), 4, 85, 0, 20)
    assert join.candidates().filter("key < 0").count() > 0  # keys of the deletion mode


@pytest.mark.parametrize("slack", [0, 4])
def test_similar_sets_share_a_key(slack):
    rng = np.random.default_rng(3)
    plan = jaccard.Plan(85, slack)
    for n in [6, 7, 8, 12, 20, 33, 60, 139, 140, 141, 400, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = plan.differing(2 * n)
            gone = int(rng.integers(0, most // 2 + 1))
            b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            have = [{k for x in plan.of(len(s)) for k in jaccard.keys(s, *x, slack)[0].tolist()} for s in (a, b)]
            assert len(a) == both == len(b) or len(have[0] & have[1]) > min(slack, len(a) // 8) / 2


def test_deletion_keys_meet_parts_that_differ_by_one():
    rng = np.random.default_rng(8)
    plan = jaccard.Plan(85, 0)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    band, segments, differ = plan.of(300)[0]
    b = a[1:]  # one shingle less, so all parts but one are equal
    left = set(np.intersect1d(jaccard.keys(a, band, segments, differ, 0)[0], jaccard.keys(b, band, segments, differ, 0)[0]).tolist())
    x, _ = jaccard.keys(a, band, segments, differ, 0, left)  # all equal parts are hot and left out
    y, _ = jaccard.keys(b, band, segments, differ, 0, left)
    at = (a >> np.uint64(20)) % np.uint64(segments)
    within = at[0] in np.unique(at)[:differ + 1]
    assert (len(np.intersect1d(x, y)) > 0) == (within and (at == at[0]).sum() > 1)


def test_rows_that_share_many_keys_are_joined_by_one(spark, frame):
    # Before, near copies came once for each key that they share, some tens of times here.
    rng = random.Random(9)
    words, rows = [f"u{i}" for i in range(900)], []
    for _ in range(20):
        rows += [(len(rows) + i, t) for i, t in enumerate(near_copies(rng, words, 3, 2))]
    join = jaccard.Join(*jaccard.shingle_sets(frame(rows), 4), 4, 85, 4, 50)
    groups = [tuple(r.rows) for r in join.candidates().groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows")).collect()]
    assert len(groups) == len(set(groups)) and all(len(g) > 1 for g in groups)
    assert found(jaccard.jaccard_components(frame(rows))) == plain(rows)


@pytest.mark.parametrize("step", [2, 2**20, 2**34])  # the last: rows of many partitions, cut to 32 bits before
def test_blocks_keep_members_and_find_repeated_keys(step):
    rng, buckets, want = np.random.default_rng(6), 3, {}
    common = rng.integers(0, 2**63, 40).astype(np.uint64)
    parts = []
    for member in (7 + step * np.arange(30)).tolist():
        k = np.unique(np.r_[rng.choice(common, 5, replace=False), rng.integers(0, 2**63, 50).astype(np.uint64)])
        parts.append((k, np.full(len(k), member)))
        for key in jaccard._short(k, buckets).tolist():
            want.setdefault(key, set()).add(member)
    batches = [b.select([0, 1]) for half in (parts[:15], parts[15:]) for b in jaccard._blocks(iter(half), buckets)]
    table, got = pa.Table.from_batches(batches), {}
    for bucket in set(table.column("bucket").to_pylist()):
        met = jaccard._met(table.filter(pc.equal(table.column("bucket"), bucket)))
        for key, member in zip(*(c.to_pylist() for c in met.columns)):
            got.setdefault(key, []).append(member)
    assert all(len(m) == len(set(m)) for m in got.values())
    assert {k: set(m) for k, m in got.items()} == {k: m for k, m in want.items() if len(m) > 1}


def test_sketches_never_rule_out_and_tell_long_sets_apart():
    rng = np.random.default_rng(2)
    sketch = lambda s: len(s).to_bytes(8, "little") + jaccard.parities(s).tobytes()
    for n, m in [(1, 1), (5, 300), (256, 257), (1000, 1100), (3000, 20000)]:
        for both in {0, n // 2, n * 9 // 10, n}:
            pool = np.unique(rng.integers(0, 2**63, n + m).astype(np.uint64))
            pool = rng.permutation(pool)
            a, b = pool[:n], np.r_[pool[:both], pool[n:n + m - both]]
            differ, total = jaccard.apart(sketch(a), sketch(b))
            assert differ <= n + m - 2 * both and total == n + m
    a, b = (np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64)) for _ in range(2))
    assert 185 * jaccard.apart(sketch(a), sketch(b))[0] > 15 * 4000  # 256 bits alone leave such a pair to the exact check


def test_bands_and_segments():
    plan = jaccard.Plan(85)
    for n in [*range(1, 3000), 10**5, 10**7]:
        bands = plan.of(n)
        assert len(bands) <= 2
        for m in {n, -(-n * 85 // 100), max(1, n * 93 // 100)}:
            if m < n or plan.differing(2 * n):
                shared = {b: (s, min(h, g)) for b, s, h in bands for c, _, g in plan.of(m) if b == c}
                assert plan.differing(n + m) == 0 or any(plan.differing(n + m) <= h and plan.differing(n + m) + 5 <= s for s, h in shared.values())


def test_empty_table_and_long_text(spark, frame):
    assert jaccard.jaccard_components(frame([(1, "a")]).limit(0)).collect() == []
    long = " ".join(f"a{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    assert found(jaccard.jaccard_components(frame(rows))) == [(1, 149_997, 1), (2, 149_998, 1), (3, len(shingles(rows[2][1])), 3)]


def test_whole_table(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert found(jaccard.op13_ngram_jaccard(spark, SF).select("doc_id", "n_shingles", F.col("component_id"))) == plain(rows)
