"""Packing, sharding and mixing: the laws their results obey."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from longview.llm import mixing, packing, queries, sharding
from longview.llm.common import words_in
from pyspark.sql import functions as F
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def law(rows, limit=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return by


def test_packing_whole_table(spark, documents):
    got = queries.QUERIES["op1_packing"](spark, SF).collect()
    law(got)
    tok, texts = Tokenizer.from_file(PATH), {r.doc_id: r.text for r in documents.collect()}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by.keys() == texts.keys()
    for doc_id, parts in by.items():
        ids = np.array(tok.encode(texts[doc_id], add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("text", ["", " ", "  a b", "a  b", " a \n b", "a\n\n b", "<|endoftext|>", "a <|endoftext|> b", "a \n", "It's 's  c", "x" * 5000, "a\x1c b", "é 😀 a", "a　 b"])
def test_encoder_equals_the_tokenizer(text):
    e = packing.encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(e.ids(text), dtype="<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_merging_by_rank_equals_the_tokenizer(tmp_path):
    assert packing.merges_by_rank(PATH)
    fast, whole = packing.Encoder(PATH, True), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    points = [c for c in [*range(1, 0x3000), *range(0xA000, 0xE000, 7), *range(0xF900, 0x20000, 11)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}2{chr(c)}{chr(c)} {chr(c)}  {chr(c)}.{chr(c)}" for c in points]
    texts += ["".join(rng.choice("abeis t'nr.1 \n\té") for _ in range(rng.randint(1, 300))) for _ in range(2000)]
    texts += [" " * 150_000 + "x" + " " * 150_000, "ab" * 60_000, "a" + "\n" * 99_999 + "b"]
    for text, e in zip(texts, whole.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(fast.ids(text), dtype="<u4").tolist() == e.ids
    file = json.loads(open(PATH, encoding="utf-8").read())
    odd = tmp_path / "odd.json"
    last = file["model"]["merges"].pop()  # its token can no longer be reached by merges, but its rank would still be met
    odd.write_text(json.dumps(file), encoding="utf-8")
    assert last and not packing.merges_by_rank(str(odd))
    file["model"]["merges"] = file["model"]["merges"][::-1]
    odd.write_text(json.dumps(file), encoding="utf-8")
    assert not packing.merges_by_rank(str(odd))


def test_packing_edges(frame):
    rows = [(1, None), (2, ""), (3, "word " * 6000), (4, "a b"), (4, "a b"), (None, "c d e")]
    parts = packing.pieces(frame(rows), PATH, limit=64, with_ids=True)
    placed = packing.pack(parts.drop("ids"), limit=64)
    got = placed.collect()
    law(got, 64)
    assert {r.doc_id: r.doc_tokens for r in got} == {1: 1, 2: 1, 3: 6002, 4: 3, None: 4}
    assert sum(r.doc_id == 4 for r in got) == 2
    full = packing.packed_sequences(parts, placed, limit=64).collect()
    assert sum(len(r.ids) // 4 for r in full) == sum(r.length for r in got)
    assert all(r.padding == (0 if (len(r.ids) // 4).bit_count() == 1 else 64 - len(r.ids) // 4) for r in full)
    assert packing.pack(packing.pieces(frame([]), PATH)).collect() == []


def test_shortest_pack_first_places_every_piece():
    rnd = random.Random(4)
    for _ in range(50):
        limit = rnd.choice([8, 64, 100])
        histogram = {rnd.randint(1, limit): rnd.randint(1, 500) for _ in range(rnd.randint(1, 40))}
        patterns = packing.shortest_pack_first(histogram, limit)
        used = defaultdict(int)
        for pattern, packs in patterns:
            assert sum(length * times for length, times in pattern) <= limit and packs > 0
            for length, times in pattern:
                used[length] += times * packs
        assert used == histogram
    assert packing.shortest_pack_first({700: 2, 300: 3, 24: 5}, 1024) == packing.shortest_pack_first({24: 5, 300: 3, 700: 2}, 1024)


def test_sharding_whole_table(spark, documents):
    got = queries.QUERIES["op4_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    mean, largest = sum(load.values()) / 40, max(r.size for r in got)
    assert all(abs(load[s] - mean) <= largest for s in range(40))


def test_sharding_hot_text_and_edges(frame):
    rows = [(i, "the same hot text") for i in range(300)] + [(1000 + i, f"text {i} " * (i % 7)) for i in range(600)] + [(None, None), (3, None), (3, None)]
    got = sharding.shards(frame(rows), 10).collect()
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 10
    assert all(abs(v - mean) < 0.06 * mean for v in load.values()) and len(load) == 10
    assert sharding.shards(frame([]), 10).collect() == []
    assert [(r.shard in range(10), r.slot, r.text_crc32) for r in sharding.shards(frame([(1, None)]), 10).collect()] == [(True, 0, 0)]


def fill(sizes, weights, most):
    """Targets by sharing what is above the caps anew until nothing is."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w >= most * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in over)
        free -= over
    return target


def test_mixing_targets_and_totals(spark, documents):
    got = queries.QUERIES["op6_mixing"](spark, SF).collect()
    again = queries.QUERIES["op6_mixing"](spark, SF).collect()
    assert sorted(got) == sorted(again)
    source = {r.doc_id: r.source for r in documents.collect()}
    names = sorted(set(source.values()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    want = fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    assert all(abs(target[s] - w) < 1e-6 * (1 + w) for s, w in zip(names, want))
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)


def test_mixing_many_rows_and_edges(frame):
    rows = [(i, "w " * (i * 7919 % 50), "en", "big") for i in range(2500)] + [(9000 + i, "v " * 9, "en", "small") for i in range(40)]
    rows += [(1, "a b c", "en", None), (1, "a b c", "en", None), (None, None, "en", None), (2, None, "en", "empty")]
    got = mixing.copies(frame(rows), words_in(F.col("text")), carry={"src": F.col("source")}).collect()
    assert len(got) == len(rows)
    for s in ("big", "small", None):
        own = [r for r in got if r.src == s]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= 9, s
    assert all(r.target == 0 for r in got if r.src == "empty")
    assert mixing.copies(frame([]), words_in(F.col("text"))).collect() == []


def test_flight_keeps_both_totals():
    rnd = random.Random(5)
    sizes = [rnd.randint(0, 400) for _ in range(300)]
    p = mixing.fly(sizes, [0.37] * 300, "x", False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 0.37 * 300) < 1e-6 and abs(sum(a * b for a, b in zip(p, sizes)) - 0.37 * sum(sizes)) < 1e-3
    assert set(mixing.fly([5] * 40, [0.5] * 40, "y", True)) <= {0.0, 1.0}
