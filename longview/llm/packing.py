"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most ``limit`` tokens. Only the histogram of piece lengths (``limit`` counts,
whatever the size of the corpus) goes to the driver, which places lengths longest first and keeps counts of packing
patterns. Each pattern then owns a range of ranks of every length it holds, and pieces find their place by their rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.llm.common import written

#: Pieces that one task ranks at once, on average.
RANKED_AT_ONCE = 4096


#: The pattern by which byte-level tokenizers cut a text into words: a fixed value of that kind of tokenizer.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Runs of white space from which on a text goes to the tokenizers library, whose pattern matching has no step limit.
LONG_RUN = 100_000


def _bytes_of_signs() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merges_by_rank(path: str) -> bool:
    """Whether the file is a byte-level tokenizer whose ids follow from the ranks of its tokens alone.

    It is if ids rise in the order of the merges and every token, spelt out, is merged to itself. Two parts of a token that
    stand side by side are then always the two that its merge rule names, so taking the pair of the lowest id is the
    same as taking the first rule that fits.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    if (model.get("type", "BPE") != "BPE" or whole.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))):
        return False
    vocab, signs = model["vocab"], _bytes_of_signs()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    words = list(vocab)
    if any(a >= b for a, b in zip(merged, merged[1:])) or not signs.keys() <= vocab.keys() or any(not signs.keys() >= set(w) for w in words):
        return False
    bare = Tokenizer.from_str(json.dumps(whole | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None, "decoder": None}))
    return all(e.ids == [vocab[w]] for w, e in zip(words, bare.encode_batch_fast(words, add_special_tokens=False)))


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by a tokenizer file of the tokenizers library.

    With ``by_rank`` (see ``merges_by_rank``) the ids come from a merger that needs ranks only and is several times as
    fast. Texts that hold a special token or very long white space go to the library itself.
    """

    def __init__(self, path: str, by_rank: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if by_rank:
            import tiktoken

            signs = _bytes_of_signs()
            with open(path, encoding="utf-8") as f:
                vocab = json.load(f)["model"]["vocab"]
            ranks = {bytes(map(signs.__getitem__, w)): i for w, i in vocab.items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_rank: bool | None = None) -> Encoder:
    """The encoder of this Python worker."""
    by_rank = merges_by_rank(path) if by_rank is None else by_rank
    if (path, by_rank) not in _ENCODERS:
        _ENCODERS[path, by_rank] = Encoder(path, by_rank)
    return _ENCODERS[path, by_rank]


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokens of each document and the id ``end``, cut every ``limit`` tokens.

    Columns: the id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian unsigned 32-bit).
    A null text counts as empty and gives one piece of one token. Repeated rows each give their own pieces.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stop, by_rank = end.to_bytes(4, "little"), merges_by_rank(tokenizer)

    def cut(batches):
        tok = encoder(tokenizer, by_rank)
        for batch in batches:
            row, start, size, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = tok.ids(text.as_py()) + stop
                for a in range(0, len(raw), 4 * limit):
                    part = raw[a:a + 4 * limit]
                    row.append(i)
                    start.append(a // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(raw) // 4)
                    if with_ids:
                        ids.append(part)
            numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            extra = [pa.array(ids, pa.binary())] if with_ids else []
            out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *numbers, *extra], names=schema.names)
            yield out

    long = T.LongType()
    fields = [T.StructField("id", source.schema["id"].dataType), *[T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    return source.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) and how many sequences follow each.

    Lengths are placed longest first, each into the shortest packs that have room; whole groups of equal packs move at
    once, so the work depends on ``limit`` alone.
    """
    open_packs: dict[int, list] = defaultdict(list)  # by free space: [pattern, packs]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max((r for r in open_packs if open_packs[r]), default=0)
        while left and room >= length:
            if not open_packs[room]:
                room -= 1
                continue
            pattern, packs = open_packs[room].pop()
            used = min(left, packs)
            if used < packs:
                open_packs[room].append((pattern, packs - used))
            longer = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            open_packs[room - length].append((longer, used))
            left -= used
        while left:
            each = min(left, limit // length)  # once opened, a pack is the shortest until it is full
            packs = left // each
            open_packs[limit - each * length].append((((length, each),), packs))
            left -= packs * each
    return [p for r in sorted(open_packs) for p in open_packs[r]]


def slots(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length: length, first rank, rank after the last, first sequence, offset, pieces a sequence."""
    out, ranks, sequence = [], defaultdict(int), 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, ranks[length], ranks[length] + packs * times, sequence, offset, times))
            ranks[length] += packs * times
            offset += length * times
        sequence += packs
    return out


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` (written ones) with ``rank``: 0, 1, ... within each value of ``key``, however many rows share a value.

    Rows of a key are dealt over buckets, numbered within their bucket and moved up by the rows of the buckets before.
    """
    buckets = max(1, rows.count() // RANKED_AT_ONCE)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(base, [key, "_bucket"]).withColumn("rank", F.col("_base") + F.col("_inside")).drop("_bucket", "_inside", "_base")


def pack(parts: DataFrame, limit: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces; offsets of a sequence run from 0 without gaps.

    ``parts`` has the id, start, length and ids_crc32. Ties and repeated rows get places of their own; no pieces, no
    rows. The table of slots is broadcast: its size depends on ``limit``, not on the corpus.
    """
    spark = parts.sparkSession
    parts = written(parts)
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    table = spark.createDataFrame(slots(shortest_pack_first(histogram, limit)),
                                  "length long, first_rank long, next_rank long, first_sequence long, first_offset long, times long")
    place = ranked(parts, "length", id_col, "start", "ids_crc32").join(
        F.broadcast(table), ["length"]).filter("rank >= first_rank AND rank < next_rank")
    return (place.withColumn("_at", F.col("rank") - F.col("first_rank"))
            .withColumn("sequence_id", F.expr("first_sequence + _at div times"))
            .withColumn("offset", F.expr("first_offset + _at % times * length"))
            .select(*parts.columns, "sequence_id", "offset"))


def packed_sequences(parts: DataFrame, placed: DataFrame, limit: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (of the real tokens), padding.

    ``parts`` are pieces with ids. A sequence of full or power-of-two length needs no padding, others fill up to ``limit``.
    """
    ids = parts.select(id_col, "start", "ids_crc32", "ids").dropDuplicates([id_col, "start", "ids_crc32"])
    key = placed[id_col].eqNullSafe(ids[id_col]) & (placed["start"] == ids["start"]) & (placed["ids_crc32"] == ids["ids_crc32"])
    whole = placed.join(ids, key).select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(limit - F.col("n"))
    return whole.select("sequence_id", joined.alias("ids"), pad.alias("padding"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
