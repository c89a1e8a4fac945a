"""Conversation repair against a cheapest-first search over whole edit strings."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from longview.llm import conversations
from tests.conftest import SF

KIND = "conv_id long, turn long, role string, text string, pos string, block string, code string, first string, h1 string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def search(turns):
    """(cost, letters, lines): the least by cost, then letters, popped first."""
    seen, done, kinds = set(), set(), []
    for role, text in turns:
        bare = text.strip(SPACES)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]  # cost, letters, rows read, initials so far, lines
    while heap:
        cost, letters, i, initials, lines = heappop(heap)
        fits = re.fullmatch("s?(ua)*u?", initials)
        if not fits or (i, initials[-1:]) in done:
            continue
        done.add((i, initials[-1:]))
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, lines, kinds
        for role in ("user", "assistant"):
            heappush(heap, (cost + 3, letters + "I", i, initials + role[0], (*lines, f"{role}:")))
        if i < len(turns):
            role, text = turns[i]
            heappush(heap, (cost + 4, letters + "D", i + 1, initials, lines))
            if kinds[i] in ("", "truncated"):
                more = 3 * (kinds[i] == "truncated")
                heappush(heap, (cost + more, letters + "K", i + 1, initials + (role[:1] if role[:1] in ("s", "u", "a") else "x"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heappush(heap, (cost + 3 + more, letters + "R", i + 1, initials + new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def plain(rows, original=None):
    out = []
    for conv in {r[0] for r in original or rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        cost, letters, lines, kinds = search([r[2:] for r in own])
        at = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "What?", "Fine! ", "Hello there", "Hi.\n", "a.b", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User"]
    return [(conv, turn + 2 * (rng.random() < 0.1), rng.choice(roles[:rng.choice([3, 8])]), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.")
            for conv in range(n) for turn in range(rng.randint(1, 9))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"vwxyz") for r in rows], KIND)


def test_repairs_equal_the_search(spark):
    rows = sample(1, 60)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (70, None, "user", "a."), (70, None, "assistant", "b."), (70, 5, "user", "c."),
             (71, 3, "user", "same."), (71, 3, "user", "same."), (72, None, " ", " "), (73, 10**9, "system", "s."), (73, -10**9, "user", "x" * 200_000 + " ."),
             (74, 1, "user", "tail" + " " * 200_000), (75, 1, "assistant", " " * 300_000 + "x.")]
    got = conversations.Repair(frame(spark, rows)).summary()
    assert found(got) == plain(rows)


def test_nulls_are_one_space(spark):
    rows = [(1, 1, None, "a."), (1, 2, "user", None), (1, 3, None, None), (2, None, "user", "q?"), (2, 1, "assistant", "r.")]
    said = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(conversations.Repair(frame(spark, rows)).summary()) == plain(said)


def test_damage(spark):
    rows = sample(2, 50) + [(None, 4, None, None), (None, None, "user", "Hm."), (900, None, "user", None)]
    assert found(conversations.damaged(frame(spark, rows))) == sorted(damage(rows), key=str)


def test_a_conversation_over_many_blocks(spark):
    # 2500 rows of one conversation make ten blocks; the search runs on the letters of all rows at once.
    rng = random.Random(6)
    rows = [(500, n, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["", "no", "Same.", f"{n}."])) for n in range(2500)] + sample(3, 10)
    repair = conversations.Repair(frame(spark, rows))
    assert repair.blocks.filter("conv_id = 500").count() >= 9
    codes = [r[0] for r in repair.lines.filter("conv_id = 500").orderBy("pos").select("code").collect()]
    whole = conversations.walk(bytes(codes), conversations._END, True)[0]
    got = {r["conv_id"]: r for r in repair.summary().collect()}
    assert got[500]["audit"] == whole[0]
    assert sorted((tuple(r) for r in got.values() if r["conv_id"] != 500), key=str) == [r for r in plain(rows[2500:] + [(500, 0, "user", "a.")]) if r[0] != 500]
    text = []
    for row, role in conversations.turns_of(bytes(codes), whole[0], 0):
        text.append(f"{role}:" if row is None else f"{role or rows[row][2]}:{rows[row][3]}")
    assert got[500]["repaired_sha256"] == hashlib.sha256("\n".join(text).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_blocks_compose(seed):
    rng = random.Random(seed)
    codes = bytes(rng.choice([0, 1, 2, 3, 5, 9, 12, 13, 14, 15]) for _ in range(120))
    whole = conversations.walk(codes, conversations._END, True)[0]
    cuts = [0, 1, 17, 64, 65, 119, 120]
    parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
    vectors, state, letters = conversations.checkpoints([conversations.matrix(p) for p in parts]), 0, ""
    for n, part in enumerate(parts):
        more, state = conversations.walk(part, vectors[n + 1], n == len(parts) - 1)[state]
        letters += more
    assert letters == whole[0]
    assert vectors[0][0] == conversations.checkpoints([conversations.matrix(codes)])[0][0]


def test_empty_table(spark):
    assert conversations.Repair(frame(spark, [(1, 1, "user", "a")]).limit(0)).summary().collect() == []


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(conversations.op11_conversation_repair(spark, SF)) == plain(damage(rows), rows)
