"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

Two sets of shingles with similarity p differ in at most H shingles, H following from their sizes. The universe of
shingles is cut by hash into segments, more than H of them for each band of sizes, so two similar sets agree in at
least one segment. Each set is indexed by the part of it that falls into each segment. A part that very many sets
share (a hot key) need not be looked up: every set has ``SLACK`` segments more than it needs. A set with more hot keys
than that may look at the one-deletion neighbourhoods of its other segments instead, where two parts that differ by one
shingle meet, so that each of them counts twice; the cheaper way is taken. What meets is verified on the whole sets.

Equal sets are one node. Members of a key are compared with a few hubs of the key, then with many more and so on, and
only across components, so a group of near copies costs about its members, and no pair of an unconnected group is left
out. Of keys that the same few sets share, one is kept. Sizes and parity bits, which bound the difference of two sets
from below, rule most other pairs out before their texts are fetched: some bits a set within the join, then as many as
the set has shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import Tables, written
from longview.llm.components import components

#: Hot keys that each set may leave out, and from how many sets on a key is hot.
SLACK, HOT = 4, 50
#: Keys that one task compares at once, on average, and keys that a task holds before it passes them on.
COMPARED_AT_ONCE, HELD = 2_000_000, 1_000_000
#: Numbers of eight bytes (rows whose texts are wanted, hot keys of sets in the deletion mode) that are sent to all tasks;
#: beyond it they are joined by a shuffle.
SENT = 500_000
#: Long numbers that hold the parities of a set: which of as many classes as there are bits hold an odd number of shingles.
PARITIES = [f"p{i}" for i in range(4)]
#: Members of a key that are its hubs at first, and how many times as many next.
HUBS, MORE = 8, 16
#: Cached words of one Python worker; a full cache is emptied.
CACHED_WORDS = 500_000

_GOLD, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ALL = 2**64 - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.known, self.hash = size, {}, xxhash.xxh64_intdigest
        self.factors = [np.uint64(_GOLD * (2 * i + 1) + 2 * i & _ALL) for i in range(size)]

    @staticmethod
    def words(text: str) -> list[bytes]:
        return text.encode().lower().split()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(words) < self.size:
            whole = [self.hash(b" ".join(words), len(words))] if words else []
            return np.array(whole, dtype=np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(h) - self.size + 1
        total = sum(h[i:i + n] * f for i, f in enumerate(self.factors))
        return np.unique(_mixed(total))


def parities(found: np.ndarray) -> np.ndarray:
    """Parity bits of a set, at least as many as it has shingles. Two sets differ in at least as many shingles as bits.

    Their number is a power of two; bits laid on each other by exclusive or are those of a smaller number.
    """
    bits = max(64 * len(PARITIES), 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(bits: np.ndarray, longs: int = len(PARITIES)) -> np.ndarray:
    """Parity bits in as many long numbers."""
    return np.bitwise_xor.reduce(bits.reshape(-1, longs), axis=0)


def apart(a: bytes, b: bytes) -> tuple[int, int]:
    """How many shingles two sets differ in at least, and how many they have together, by their sketches (size and parities)."""
    a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    longs = min(len(a), len(b)) - 1
    return int(np.bitwise_count(folded(a[1:], longs) ^ folded(b[1:], longs)).sum()), int(a[0] + b[0])


class Plan:
    """Bands of set sizes, their segments, and how many of these a set of some size needs."""

    def __init__(self, percent: int, slack: int = SLACK):
        self.percent, self.slack = percent, slack
        self.edges = [1]
        while self.edges[-1] < 2**40:
            last = self.edges[-1]
            self.edges.append(max(last + 1, last * 7 // 5, -(-last * 100 // percent)))  # a set looks into two bands at most

    def differing(self, total: int) -> int:
        """Most shingles in which similar sets of ``total`` shingles together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def segments(self, band: int) -> int:
        most = self.edges[band + 1] - 1
        need = self.differing(most + most * 100 // self.percent) + 1 + self.slack
        return need * 5 // 4 + 2

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, H) for each band that holds a smaller or equal partner of a set of n shingles."""
        own, out = self.band(n), []
        for band in range(own, self.band(-(-n * self.percent // 100)) - 1, -1):
            partner = n * 100 // self.percent if band == own else self.edges[band + 1] - 1
            differ = self.differing(n + partner)
            if differ:  # else only equal sets are similar
                out.append((band, self.segments(band), differ))
        return out


def keys(shingles: np.ndarray, band: int, segments: int, differ: int, slack: int, deletions_without: set | None = None) -> tuple[np.ndarray, int]:
    """Keys of a set in a band, and for the deletion mode how many of its parts have one shingle.

    They are those of its first ``differ + 1 + slack`` segments that aren't empty, or of all segments if it hasn't so
    many. With ``deletions_without`` (short keys that are hot): keys of the other parts, and of these less one shingle.
    """
    at = (shingles >> np.uint64(20)) % np.uint64(segments)
    order = np.argsort(at, kind="stable")
    place, part = np.unique(at[order], return_index=True)
    total = np.add.reduceat(shingles[order], part)
    need = differ + 1 + slack
    if len(place) >= need:
        place, total = place[:need], total[:need]
    else:
        whole = np.zeros(segments, np.uint64)
        whole[place] = total
        place, total = np.arange(segments, dtype=np.uint64), whole
    salt = place * np.uint64(_GOLD) + np.uint64(_OTHER * (band + 1) & _ALL)
    out = _mixed(total + salt)
    if deletions_without is None:
        return out, 0
    size = np.bincount(at.astype(np.int64), minlength=segments)[place.astype(np.int64)]
    cold = ~np.isin(out, np.fromiter(deletions_without, np.uint64, len(deletions_without)))
    more = np.full(segments, -1)
    more[place[cold & (size > 1)].astype(np.int64)] = np.flatnonzero(cold & (size > 1))
    own = more[at.astype(np.int64)]
    less = _mixed(total[own] - shingles + salt[own])[own >= 0]
    return np.concatenate([out[cold], less]), int((cold & (size == 1)).sum())


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave runs of zeros, which compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, n: int, width: int) -> np.ndarray:
    """The numbers of ``_planes``."""
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel()


def _entries(short: np.ndarray, offset: np.ndarray, base: int) -> bytes:
    """Ascending short keys, by their steps, with their members less ``base``."""
    return np.array([base, len(short)], "<i8").tobytes() + _planes(np.diff(short, prepend=np.uint32(0))) + _planes(offset)


def _read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Short keys and members of ``_entries``; -1 where an entry stands for several members."""
    base, n = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16 + 4 * n
    offset = _numbers(raw[at:], n, (len(raw) - at) // n)
    many = offset == np.iinfo(offset.dtype).max
    return np.cumsum(_numbers(raw[16:at], n, 4), dtype=np.uint32), np.where(many, -1, base + offset.astype(np.int64))


def _through(key: np.ndarray, member: np.ndarray) -> tuple[int, bytes]:
    """A group of its own, below 0, for rows that only pass."""
    return -1 - int(member.min()), key.astype("<i8").tobytes() + member.astype("<i8").tobytes()


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    bucket, entries = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(entries, pa.binary())], names=["bucket", "entries"])


def _blocks(parts: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, entries) of arrays of keys and members.

    Keys go to their bucket, some five bytes an entry. A key that several members of a block share is known to be
    repeated: its members pass as they are, and the bucket gets one entry that stands for them, however many they are.
    """
    key, member = (np.concatenate(x) for x in zip(*parts))
    key = _short(key, buckets)
    order = np.argsort(key)
    key, member = key[order], member[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)])
    base, span = int(member.min()), int(member.max()) - int(member.min())
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if span < np.iinfo(t).max)
    offset = np.where(times > 1, np.iinfo(kind).max, (member[first] - base).astype(kind)).astype(kind)
    bucket, short = key[first] >> 32, key[first].astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    yield _batch([(int(bucket[a]), _entries(short[a:b], offset[a:b], base)) for a, b in zip(cut, np.r_[cut[1:], len(bucket)])])
    many = np.repeat(times > 1, times)
    if many.any():
        yield _batch([_through(key[many], member[many])])


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of a key as one number; a chance meeting under it is verified like any other."""
    return ((key >> np.uint64(32)).astype(np.int64) % buckets << 32) | key.astype(np.uint32).astype(np.int64)


def _met(table: pa.Table) -> pa.Table:
    """(key, member) of the repeated keys of one bucket, or of the rows that only pass."""
    bucket, rows = table.column("bucket")[0].as_py(), table.column("entries")
    if bucket < 0:
        key, member = np.concatenate([np.frombuffer(raw.as_py(), "<i8").reshape(2, -1) for raw in rows], axis=1)
        return pa.table({"key": key, "member": member})
    short, member = (np.concatenate(x) for x in zip(*[_read(raw.as_py()) for raw in rows]))
    order = np.argsort(short, kind="stable")
    short, member = short[order], member[order]
    same = short[1:] == short[:-1]
    twice = (np.r_[same, False] | np.r_[False, same]) & (member >= 0)
    return pa.table({"key": (bucket << 32) | short[twice].astype(np.int64), "member": member[twice]})


def _repeated(blocks: DataFrame) -> DataFrame:
    """(key, member) for each key that at least two members have, key -1 for failed ones; a member is 2 * row + band."""
    return blocks.groupBy("bucket").applyInArrow(_met, "key long, member long")


def _different(met: DataFrame, hot: int, table: Tables) -> DataFrame:
    """(key, member, row, sharing): ``met`` without keys of a single row, and one key of those that the same rows share.

    Near copies share many keys, of which one leads to the same pairs as all. Hot keys are all kept, as their number
    counts. Sets of rows are told by their number, least, greatest and 64 bits of all.
    """
    rows = met.withColumn("row", F.shiftright("member", 1))
    groups = rows.groupBy("key").agg(F.count("*").alias("sharing"), F.min("row").alias("a"), F.max("row").alias("b"), F.bit_xor(F.xxhash64("row")).alias("all"))
    groups = table(groups.filter("a < b"))
    cold = groups.filter(F.col("sharing") <= hot).groupBy("sharing", "a", "b", "all").agg(F.min("key").alias("key")).select("key", "sharing")
    return rows.join(table(cold.union(groups.filter(F.col("sharing") > hot).select("key", "sharing"))), "key")


def narrowed(texts: DataFrame, rows: DataFrame, table: Tables) -> DataFrame:
    """Texts of the given rows. Up to ``SENT`` rows are sent to all tasks, so that the others' texts aren't shuffled."""
    rows = table(rows.distinct())
    return texts.join(F.broadcast(rows) if rows.count() <= SENT else rows, "row")


class Join:
    """The steps of the join over one table of sets: (row, n, set, packed)."""

    def __init__(self, sets: DataFrame, nodes: DataFrame, shingle: int, percent: int, slack: int, hot: int):
        self.sets, self.nodes, self.shingle, self.plan, self.hot = sets, nodes, shingle, Plan(percent, slack), hot
        spark = sets.sparkSession
        work = sets.agg(F.sum("n")).first()[0] or 0
        self.buckets = max(spark.sparkContext.defaultParallelism, int(work * 0.3) // COMPARED_AT_ONCE)

    def _blocks(self, rows: DataFrame, deletions: bool) -> DataFrame:
        plan, size, buckets = self.plan, self.shingle, self.buckets

        def block(batches):
            shingles, held, n = Shingles(size), [], 0
            failed = []
            for batch in batches:
                seen = set()
                columns = [c.to_pylist() for c in batch.columns]
                for row, same, packed, *hot in zip(*columns):
                    if same in seen and not deletions:
                        continue  # copies within a batch; the first row of a set is never left out
                    seen.add(same)
                    found = shingles(zlib.decompress(packed).split())
                    for i, (band, segments, differ) in enumerate(plan.of(len(found))):
                        if not deletions:
                            k, _ = keys(found, band, segments, differ, plan.slack)
                        elif hot[0] == i:
                            own, _ = keys(found, band, segments, differ, plan.slack)
                            left = set(own[np.isin(_short(own, buckets), hot[1])].tolist())
                            k, single = keys(found, band, segments, differ, plan.slack, left)
                            if len(left) + single > plan.slack + 3 * (differ + 1) // 10:
                                failed.append(2 * row + i)
                                continue
                        else:
                            continue
                        held.append((np.unique(k), 2 * row + i))
                        n += len(k)
                    if n > HELD:
                        yield from _blocks(((k, np.full(len(k), m)) for k, m in held), buckets)
                        held, n = [], 0
            if n:
                yield from _blocks(((k, np.full(len(k), m)) for k, m in held), buckets)
            if failed:
                yield _batch([_through(np.full(len(failed), -1), np.array(failed))])

        return rows.mapInArrow(block, "bucket long, entries binary")

    def candidates(self, table: Tables | None = None) -> DataFrame:
        """(key, row, n, probe, parities): rows of a key may be similar if one of them is to be looked up."""
        table = table or Tables(self.sets.sparkSession)
        rows = self.sets.filter("n > 0").select("row", "set", "packed")
        met = _repeated(self._blocks(rows, False)).withColumn("row", F.shiftright("member", 1))
        met = table(met.join(self.nodes.select("row"), "row", "left_semi").select("key", "member"))  # copies go
        met = table(_different(met, self.hot, table))
        hot = F.col("sharing") > self.hot
        load = met.filter(hot).groupBy("member", "row").agg(F.count("*").alias("hot"), F.sum("sharing").alias("load"), F.collect_list("key").alias("keys"))
        load = table(load.filter(F.col("hot") > self.plan.slack).join(self.nodes.select("row", "n"), "row"))  # keys: at most as many as the set has segments
        dearer = (F.col("load") > F.col("n")) & (F.col("hot") <= self.plan.slack + F.col("n") / 18 + 1)
        by_deletion = load.filter(dearer).select("row", F.col("member").bitwiseAND(1).alias("band"), "keys")
        if (by_deletion.agg(F.sum(F.size("keys"))).first()[0] or 0) <= SENT:
            by_deletion = F.broadcast(by_deletion)
        more = self.sets.select("row", "set", "packed").join(by_deletion, "row").select("row", "set", "packed", "band", "keys")
        more = table(_repeated(self._blocks(more, True)))
        failed = more.filter("key = -1").select("member")
        whole = table(load.filter(~dearer).select("member").union(failed).distinct().withColumn("whole", F.lit(True)))
        found = met.filter(~hot).select("key", "row", F.lit(True).alias("probe"))
        found = found.union(met.filter(hot).join(whole, "member", "left").select("key", "row", F.col("whole").isNotNull()))
        near = more.filter("key <> -1").select((-1 - F.col("key")).alias("key"), F.shiftright("member", 1).alias("row"), F.lit(True).alias("probe")).distinct()
        return found.union(near).join(self.nodes.select("row", "n", *PARITIES), "row").select("key", "row", "n", "probe", *PARITIES)

    def together(self, pairs: DataFrame, values: DataFrame, table: Tables) -> DataFrame:
        """(hub, row, a, b): the pairs with the value of the hub and that of the row."""
        # Written first: either join may then split a hub that is in very many pairs.
        half = table(pairs.join(values, "row").select("hub", "row", F.col("value").alias("b")))
        return half.join(values.select(F.col("row").alias("hub"), F.col("value").alias("a")), "hub").select("hub", "row", "a", "b")

    def plausible(self, pairs: DataFrame, texts: DataFrame, table: Tables) -> DataFrame:
        """The pairs (hub, row) without those that their sketches rule out."""
        percent = self.plan.percent

        def check(batches):
            for batch in batches:
                fine = [(100 + percent) * differ <= (100 - percent) * total for differ, total in map(apart, *(c.to_pylist() for c in batch.columns[2:]))]
                yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

        return self.together(pairs, texts.select("row", F.col("sketch").alias("value")), table).mapInArrow(check, "hub long, row long")

    def verified(self, pairs: DataFrame, texts: DataFrame, table: Tables) -> DataFrame:
        """The pairs (hub, row) that are similar, by their whole sets."""
        percent, size = self.plan.percent, self.shingle

        def check(batches):
            shingles, recent = Shingles(size), {}

            def of(row, packed):
                if row not in recent:
                    if len(recent) > 64:
                        recent.clear()
                    recent[row] = shingles(zlib.decompress(packed).split())
                return recent[row]

            for batch in batches:
                fine = []
                for hub, row, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                    x, y = of(hub, a), shingles(zlib.decompress(b).split())
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    fine.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

        texts = narrowed(texts.select("row", F.col("packed").alias("value")), pairs.select("row").union(pairs.select("hub")), table)
        return self.together(pairs, texts, table).mapInArrow(check, "hub long, row long")

    def roots(self) -> DataFrame | None:
        """(row, root) of each node that shares a key with another; root is the first row of its component."""
        spark = self.sets.sparkSession
        table, passing = Tables(spark), Tables(spark)
        open_ = table(self.candidates(passing))
        passing.drop()
        if open_.isEmpty():
            table.drop()
            return None
        placed = table(open_.select("row").distinct().withColumn("root", F.col("row")))
        texts = written(narrowed(self.sets.select("row", "packed", "sketch"), placed.select("row"), table))
        width = HUBS
        while True:
            now = open_.join(placed, "row")
            spread = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("probe").alias("probe"))
            open_ = table(now.join(spread.filter("a < b AND probe").select("key"), "key"))
            if open_.isEmpty():
                break
            order = Window.partitionBy("key").orderBy(F.xxhash64("row"), "row")
            hubs = open_.filter("probe").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= width)
            hubs = table(hubs.select("key", F.col("row").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"), *[F.col(p).alias(f"hub_{p}") for p in PARITIES]))
            # Which pairs can be similar by their sizes and parities is settled within the join, before pairs are rows.
            percent, differ = self.plan.percent, sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"hub_{p}"))) for p in PARITIES), F.lit(0))
            fits = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("hub_n")))
            members = open_.withColumnRenamed("key", "k")
            pairs = members.join(hubs, (F.col("k") == F.col("key")) & (F.col("root") != F.col("hub_root")) & fits)
            pairs = table(pairs.select(F.greatest("hub", "row").alias("row"), F.least("hub", "row").alias("hub")).distinct())
            passing = Tables(spark)
            links = table(self.verified(passing(self.plausible(pairs, texts, passing)), texts, passing))
            passing.drop()
            open_ = open_.join(hubs.select("key", F.col("hub").alias("row")), ["key", "row"], "left_anti").select("key", "row", "n", "probe", *PARITIES)
            width *= MORE
            if not links.isEmpty():
                of = lambda row, to: placed.select(F.col("row").alias(row), F.col("root").alias(to))
                steps = links.join(of("hub", "u"), "hub").join(of("row", "v"), "row").select("u", "v")
                steps = components(steps).select(F.col("u").alias("root"), F.col("v").alias("least"))
                placed = table(placed.join(steps, "root", "left").select("row", F.coalesce("least", "root").alias("root")))
        placed = written(placed)
        table.drop()
        return placed


def shingle_sets(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id, n, set, packed, sketch) of each row, and (set, row, id, n) of each different set with its first row."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def sets(batches):
        import xxhash

        shingles = Shingles(shingle)
        for batch in batches:
            n, same, packed, odd, sketch = [], [], [], [], []
            for text in batch.column(1):
                words = shingles.words(text.as_py())
                found = shingles(words)
                n.append(len(found))
                same.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                packed.append(zlib.compress(b" ".join(words), 1))
                bits = parities(found)
                odd.append(folded(bits))
                sketch.append(len(found).to_bytes(8, "little") + bits.tobytes())
            bits = np.array(odd, dtype=np.int64).reshape(-1, len(PARITIES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(packed, pa.binary()), pa.array(sketch, pa.binary()), *map(pa.array, bits.T.copy())],
                                             names=["id", "n", "set", "packed", "sketch", *PARITIES])

    rows = written(source.mapInArrow(sets, f"id {kind}, n long, set binary, packed binary, sketch binary, {', '.join(f'{p} long' for p in PARITIES)}")).withColumn("row", F.monotonically_increasing_id())
    nodes = written(rows.filter("n > 0").groupBy("set").agg(F.min("row").alias("row"), F.min("id").alias("id"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in PARITIES]))
    return rows, nodes


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85, slack: int = SLACK, hot: int = HOT,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id (smallest id reachable by links, its own included).

    Texts are compared by their sets of distinct word shingles, A-Z in lower case; a text with fewer words is one
    shingle. Two sets link when 100 * intersection >= ``percent`` * union. Null and empty texts have no shingle and link
    with nothing, not even each other. Equal sets link and are one node; repeated rows come back each, rows without an
    id take part and get the smallest id of their component (null if it has none). An empty table gives no rows;
    other columns are not looked at. Shingles are compared by 64-bit hashes and equal sets are told by 128 bits.

    The texts are read once and kept packed; some five bytes for each key are shuffled, and packed texts only of sets that
    share a key with another.
    """
    if not 50 <= percent <= 100:
        raise ValueError("50 to 100 percent")
    rows, nodes = shingle_sets(docs, shingle, id_col, text_col)
    roots = Join(rows, nodes, shingle, percent, slack, hot).roots()
    if roots is None:
        labels = nodes.select("set", F.col("id").alias("component_id"))
    else:
        placed = written(nodes.join(roots, "row", "left").select("set", "id", F.coalesce("root", "row").alias("root")))
        least = written(placed.groupBy("root").agg(F.min("id").alias("component_id")))
        labels = placed.join(least, "root").select("set", "component_id")
    labels = written(labels)
    linked = rows.filter("n > 0").select("id", "n", "set").join(labels, "set").select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op13_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: At most a few thousand documents: it lists all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS at FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.at)
SELECT n.doc_id, n.n AS n_shingles, min(r.at) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
