"""Conversation structure repair: a checkpointed dynamic program over the rows of each conversation.

The cheapest repair is a shortest way through four states: at the start, after a system turn, after a user turn, after
an assistant turn (which may end it). The cost of what is still to come is a vector of four numbers before every row.
Rows are cut into blocks of about the square root of the longest conversation. A block as a whole maps the vector
behind it to the one before it, as a 4 by 4 matrix of least sums, so the vectors at the block borders - the
checkpoints - come from the matrices alone. Each block then recomputes its own vectors from its checkpoint and walks
forward along tight edits, the ASCII-least first. Blocks are worked on in parallel, whatever conversation they are of.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import written

_ENDLESS = 2**60
#: Vector behind the last row: a system turn wants a user turn and an answer, a user turn an answer.
_END = (0, 6, 3, 0)
#: Role that an inserted or reroled turn has in each state, and the state after it.
_FORCED = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: State after a kept turn with initial s, u, a or another, by state; None where it can't stand.
_KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
_KINDS = ("fine", "blank", "duplicate", "truncated")
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_INITIALS = "sua"


def _edits(code: int) -> tuple:
    """Per state: (letter, cost, next state) of the edits of a row, in the order of their letters."""
    kind, initial = divmod(code, 4)
    if kind in (1, 2):
        return tuple((("D", 4, q),) for q in range(4))
    more = 3 if kind == 3 else 0
    return tuple((("D", 4, q),) + ((("K", more, _KEPT[q][initial]),) if _KEPT[q][initial] is not None else ()) + (("R", 3 + more, _NEXT[q]),)
                 for q in range(4))


EDITS = [_edits(code) for code in range(16)]


def _before(code: int, behind) -> tuple:
    """The vector before a row, with any insertions there, from the vector behind it."""
    w = [min(cost + behind[to] for _, cost, to in EDITS[code][q]) for q in range(4)]
    u, a = min(w[2], 3 + w[3]), min(w[3], 3 + w[2])
    return min(w[0], 3 + u), min(w[1], 3 + u), u, a


def matrix(codes: bytes) -> list[int]:
    """Least cost from state i before the block to state j behind it, at 4 * i + j."""
    ways = [tuple(0 if i == j else _ENDLESS for i in range(4)) for j in range(4)]
    for code in reversed(codes):
        ways = [_before(code, w) for w in ways]
    return [min(ways[j][i], _ENDLESS) for i in range(4) for j in range(4)]


def checkpoints(matrices: list[list[int]]) -> list[tuple]:
    """The vector behind each block, and first of all the one before the first block."""
    out = [_END]
    for m in reversed(matrices):
        out.append(tuple(min(m[4 * i + j] + out[-1][j] for j in range(4)) for i in range(4)))
    return out[::-1]


def walk(codes: bytes, behind: tuple, last: bool) -> list[tuple[str, int]]:
    """For each state before a block: the letters of its ASCII-least tight edits and the state behind it."""
    vectors = [tuple(behind)]
    for code in reversed(codes):
        vectors.append(_before(code, vectors[-1]))
    vectors.reverse()
    out = []
    for q in range(4):
        letters, i = [], 0
        while i < len(codes) or (last and vectors[i][q]):
            here, edits = vectors[i][q], EDITS[codes[i]][q] if i < len(codes) else ()
            if edits and here == 4 + vectors[i + 1][q]:
                letters.append("D")
                i += 1
            elif here == 3 + vectors[i][_NEXT[q]]:
                letters.append("I")
                q = _NEXT[q]
            else:
                letter, q = next((x, to) for x, cost, to in edits if here == cost + vectors[i + 1][to])
                letters.append(letter)
                i += 1
        out.append(("".join(letters), q))
    return out


def turns_of(codes: bytes, letters: str, state: int) -> list[tuple[int | None, str | None]]:
    """(row, role) of each turn after the edits; no role where it is kept, no row where it is inserted."""
    out, row = [], 0
    for x in letters:
        if x == "I":
            out.append((None, _FORCED[state]))
            state = _NEXT[state]
            continue
        if x == "K":
            out.append((row, None))
            state = _KEPT[state][codes[row] % 4]
        elif x == "R":
            out.append((row, _FORCED[state]))
            state = _NEXT[state]
        row += 1
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 chooses; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes its role user.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.filter(code != 0).select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                                                  F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Repair:
    """The cheapest repair of conversations (conv_id, turn, role, text), one row a turn.

    Rows are taken by turn (nulls first), equal turns by role and text; null roles and texts count as one space, a null
    conv_id is a conversation. A row's first fault counts: blank (no character that isn't ASCII white space), duplicate
    (role and text of an earlier row), truncated (its last such character is none of ``.!?``). Keeping a row costs 0, a
    new role (user or assistant) 3, deletion 4, an inserted empty turn of user or assistant 3; blank and duplicate rows
    must go, truncated ones that stay cost 3 more. The initials of the roles that remain form ``(s?(ua)+)?``. Of cheapest
    repairs the one whose edits have the ASCII-least initials is taken. Repeated rows are duplicates; an empty table gives
    no rows; texts of any length and columns of other names make no difference.

    Rows are sorted over all tasks and dealt to blocks, so a conversation may hold most rows of the table. Only the hash of
    a whole repaired conversation reads its turns one after the other, since sha256 can't be taken in parts.
    """

    def __init__(self, rows: DataFrame):
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
        rows = rows.withColumn("tie", F.monotonically_increasing_id())  # lets many equal rows go to several tasks
        rows = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie").drop("tie")
        self.rows = written(rows).withColumn("pos", F.monotonically_increasing_id())
        self.lines = written(self._faults())
        self.blocks = written(self._blocks())

    def _faults(self) -> DataFrame:
        """(conv_id, pos, turn, code): kind and initial of each row in one number."""
        bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
        kind = F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
        initial = F.coalesce(*[F.when(F.startswith("role", F.lit(x)), i) for i, x in enumerate(_INITIALS)], F.lit(3))
        said = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")]
        rows = written(self.rows.select("conv_id", "pos", "turn", kind.alias("kind"), initial.alias("initial"), *said))
        again = rows.filter("kind <> 1").groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
        again = written(again.select(F.col("conv_id").alias("conv"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"))
        both = rows.join(again, _same("conv_id", "conv") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
        kind = F.when((F.col("kind") != 1) & (F.col("pos") > F.col("first")), 2).otherwise(F.col("kind"))
        return both.select("conv_id", "pos", "turn", (kind * 4 + F.col("initial")).alias("code"))

    def _blocks(self) -> DataFrame:
        """(conv_id, block, first, codes, matrix, illegal, ends) of each block of consecutive rows of a conversation."""
        longest = self.lines.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
        shift = max(8, math.ceil(math.log2(math.sqrt(longest))))
        cut = self.lines.groupBy("conv_id", F.shiftright("pos", shift).alias("block")).agg(
            F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))  # at most 2 ** shift rows

        def summed(batches):
            for batch in batches:
                codes = [bytes(x) for x in batch.column(3).to_pylist()]
                initial = [[c % 4 for c in x] for x in codes]
                illegal = [sum(p not in _LEGAL for p in zip(x, x[1:])) for x in initial]
                ends = [x[0] * 4 + x[-1] for x in initial]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary()), pa.array(map(matrix, codes), pa.list_(pa.int64())),
                                                  pa.array(illegal, pa.int64()), pa.array(ends, pa.int64())],
                                                 names=["conv_id", "block", "first", "codes", "matrix", "illegal", "ends"])

        codes = cut.select("conv_id", "block", "first", F.transform("rows", lambda r: r["code"]).alias("codes"))
        return codes.mapInArrow(summed, f"conv_id {self.kind}, block long, first long, codes binary, matrix array<long>, illegal long, ends long")

    def _by_conversation(self, rows: DataFrame, columns: list[str], work, result: str) -> DataFrame:
        """``work`` on the blocks' summaries of each conversation, in order."""
        lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("blocks"))

        def each(batches):
            for batch in batches:
                done = [work(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, kind)], names=["conv_id", "done"])

        kind = _arrow(result)
        return lists.mapInArrow(each, f"conv_id {self.kind}, done {result}")

    def walked(self) -> DataFrame:
        """(conv_id, block, first, codes, state, letters, cost, illegal) of each block in the repair of its conversation;
        cost and illegal pairs are those of the whole conversation."""

        def backward(blocks):
            vectors = checkpoints([b["matrix"] for b in blocks])
            border = sum((a["ends"] % 4, b["ends"] // 4) not in _LEGAL for a, b in zip(blocks, blocks[1:]))
            return {"cost": vectors[0][0], "illegal": border + sum(b["illegal"] for b in blocks),
                    "at": [{"block": b["block"], "behind": list(v), "last": b is blocks[-1]} for b, v in zip(blocks, vectors[1:])]}

        found = written(self._by_conversation(self.blocks, ["matrix", "illegal", "ends"], backward,
                                              "struct<cost:bigint,illegal:bigint,at:array<struct<block:bigint,behind:array<bigint>,last:boolean>>>"))
        at = found.select(F.col("conv_id").alias("conv"), F.col("done.cost").alias("cost"), F.col("done.illegal").alias("illegal_pairs"), F.explode("done.at").alias("at"))
        at = at.select("conv", "cost", "illegal_pairs", F.col("at.block").alias("at_block"), "at.behind", "at.last")
        rows = self.blocks.join(at, _same("conv_id", "conv") & (F.col("block") == F.col("at_block")))

        def forward(batches):
            for batch in batches:
                ways = [walk(c, tuple(b), z) for c, b, z in zip(*[batch.column(i).to_pylist() for i in (3, 6, 7)])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([[x for x, _ in w] for w in ways], pa.list_(pa.string())),
                                                  pa.array([[x for _, x in w] for w in ways], pa.list_(pa.int64()))],
                                                 names=["conv_id", "block", "first", "codes", "cost", "illegal", "letters", "exits"])

        ways = rows.select("conv_id", "block", "first", "codes", "cost", F.col("illegal_pairs").alias("illegal"), "behind", "last").mapInArrow(
            forward, f"conv_id {self.kind}, block long, first long, codes binary, cost long, illegal long, letters array<string>, exits array<long>")
        ways = written(ways)

        def entered(blocks):
            out, state = [], 0
            for b in blocks:
                out.append({"block": b["block"], "state": state})
                state = b["exits"][state]
            return out

        entry = self._by_conversation(ways, ["exits"], entered, "array<struct<block:bigint,state:bigint>>")
        entry = entry.select(F.col("conv_id").alias("conv"), F.explode("done").alias("at")).select("conv", F.col("at.block").alias("at_block"), "at.state")
        chosen = ways.join(entry, _same("conv_id", "conv") & (F.col("block") == F.col("at_block")))
        return chosen.select("conv_id", "block", "first", "codes", "state", F.get("letters", F.col("state").cast("int")).alias("letters"), "cost", "illegal")

    def turns(self, walked: DataFrame) -> DataFrame:
        """(conv_id, block, number, role, text): the repaired conversations, in the order of block and number."""

        def placed(batches):
            for batch in batches:
                out = [(conv, block, n, None if row is None else first + row, role)
                       for conv, block, first, codes, state, letters in zip(*[c.to_pylist() for c in batch.columns])
                       for n, (row, role) in enumerate(turns_of(codes, letters, state))]
                columns = zip(*out) if out else [[]] * 5
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv_id", "block", "number", "at", "new_role"])

        at = written(walked.select("conv_id", "block", "first", "codes", "state", "letters").mapInArrow(
            placed, f"conv_id {self.kind}, block long, number long, at long, new_role string"))
        kept = at.filter("at IS NOT NULL").join(self.rows.select("pos", "role", "text"), F.col("at") == F.col("pos"))
        kept = kept.select("conv_id", "block", "number", F.coalesce("new_role", "role").alias("role"), "text")
        return kept.union(at.filter("at IS NULL").select("conv_id", "block", "number", F.col("new_role").alias("role"), F.lit("").alias("text")))

    def hashes(self, turns: DataFrame) -> DataFrame:
        """(conv_id, repaired_sha256) of the lines ``role:text`` of each conversation that has turns left."""

        def stream(batches):
            conv, state = None, None
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                done = []
                for c, role, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                    if state is not None and c == conv:
                        state.update(b"\n")
                    else:
                        if state is not None:
                            done.append((conv, state.hexdigest()))
                        conv, state = c, hashlib.sha256()
                    state.update(f"{role}:{text.as_py()}".encode())
                if done:
                    yield _pairs(done, kind)
            if state is not None:
                yield _pairs([(conv, state.hexdigest())], kind)

        together = turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "number")
        return together.mapInArrow(stream, f"conv_id {self.kind}, repaired_sha256 string")

    def summary(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        walked = written(self.walked())
        wide = F.col("turn").cast("decimal(38,0)")
        counts = self.lines.groupBy("conv_id").agg(
            F.coalesce((F.max(wide) - F.min(wide) + 1 - F.countDistinct("turn")).cast("long"), F.lit(0)).alias("gaps"),
            *[F.count(F.when(F.shiftright("code", 2) == i, 1)).alias(k) for i, k in enumerate(_KINDS) if i])
        letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "")
        edits = walked.groupBy(F.col("conv_id").alias("c1")).agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), letters.alias("audit"))
        digest = self.hashes(self.turns(walked)).withColumnRenamed("conv_id", "c2")
        out = counts.join(edits, _same("conv_id", "c1")).join(digest, _same("conv_id", "c2"), "left")
        return out.select("conv_id", "gaps", *_KINDS[1:], "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _pairs(done: list, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], names=["conv_id", "repaired_sha256"])


def _arrow(kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = conversations.select(F.col("conv_id").alias("original")).distinct()
    found = every.join(Repair(damaged(conversations)).summary(), _same("original", "conv_id"), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_KINDS[1:], "illegal", "cost")]
    return found.select(F.col("original").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The program run forwards: per state the least (cost, letters, lines), extended row by row."""
    def to(v: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"{v}.r" if line is None else f"list_append({v}.r, {line})"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'r': {lines}}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    none = "{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}"
    inserted = lambda v: to(v, "3", "I", "'user:'")
    twice = lambda v: f"{{'c': {v}.c + 6, 'a': {v}.a || 'II', 'r': {v}.r || ['user:', 'assistant:']}}"
    closed = f"""v0 AS x0, v1 AS x1, {least("v2", *map(inserted, ("v0", "v1", "v3")))} AS x2,
 {least("v3", to("v2", "3", "I", "'assistant:'"), *map(twice, ("v0", "v1")))} AS x3"""
    off = lambda test, way: f"CASE WHEN {test} THEN {way} ELSE {none} END"
    more, stays = "CASE WHEN kind = 3 THEN 3 ELSE 0 END", "kind IN (0, 3)"
    keep = lambda v, i: off(f"{stays} AND init = '{i}'", to(v, more, "K", "role || ':' || text"))
    turn = lambda v, role: off(stays, to(v, f"3 + {more}", "R", f"'{role}:' || text"))
    gone = lambda v: to(v, "4", "D")
    step = f"""{gone("x0")} AS v0, {least(gone("x1"), keep("x0", "s"))} AS v1,
 {least(gone("x2"), *[keep(x, "u") for x in ("x0", "x1", "x3")], *[turn(x, "user") for x in ("x0", "x1", "x3")])} AS v2,
 {least(gone("x3"), keep("x2", "a"), turn("x2", "assistant"))} AS v3"""
    return rf"""
WITH RECURSIVE t AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295] || list_transform(string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda c, b: xor(t.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS code FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
      CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
      FROM h WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
      left(role, 1) AS init, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
k AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS kind,
      lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS v0, {none} AS v1, {none} AS v2, {none} AS v3 FROM k
      UNION ALL SELECT conv_id, i, {step} FROM (SELECT k.*, {closed} FROM w JOIN k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1)),
z AS (SELECT conv_id, {least("x0", "x3")} AS best FROM (SELECT conv_id, i AS place, {closed} FROM w) JOIN (SELECT conv_id AS c, max(i) AS top FROM k GROUP BY conv_id) m
      ON c IS NOT DISTINCT FROM conv_id AND top = place),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 1) AS blank, count(*) FILTER (WHERE kind = 2) AS duplicate,
      count(*) FILTER (WHERE kind = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
SELECT o.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(s.illegal, 0) AS illegal, CAST(coalesce(z.best.c, 0) AS BIGINT) AS cost, coalesce(z.best.a, '') AS audit,
       sha256(coalesce(array_to_string(z.best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
