"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

Two words are alike by the letter triples they share in order, with gaps: a triple that spans s letters counts
DECAY ** s, up to a span of SPAN. So an insult keeps most of its likeness with inserted letters, dots or blanks.
The kernel is linear in its triples, hence the machine over the landmarks' kernel values folds into one weight a
triple, a table of fixed size, and a text is scored by table look-ups over its letters.

Labels mark whole texts, so the words to blame are learnt: sentences of clean texts give negative words, and each
toxic text gives the words that look worst under the machine of the round before.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECAY, SPAN, LANDMARKS, ROUNDS = 0.85, 7, 192, 3
#: Toxic texts that the machine is fitted on, at most (and twice as many others); the longest of them in characters.
SAMPLE, SAMPLE_CHARS = 1500, 50_000
#: Words a text gives to a round of fitting.
WORST = 3
GAP, SYMBOLS = 62, 64
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


@cache
def _fold() -> np.ndarray:
    """Symbol of each character: 0 white space, 1-26 letters without accents, 27-36 digits, 62 other signs."""
    table = np.full(0x3000, GAP, dtype=np.uint8)
    looks_like = dict(zip("013457@$", "oieastas"))
    for i in range(0x3000):
        c = chr(i)
        base = unicodedata.normalize("NFKD", c.lower())[:1]
        base = looks_like.get(base, base)
        if c.isspace():
            table[i] = 0
        elif "a" <= base <= "z":
            table[i] = ord(base) - 96
        elif "0" <= base <= "9":
            table[i] = 27 + ord(base) - 48
        elif c.isalpha():
            table[i] = 37 + i % 25
    return table


def symbols(text: str) -> np.ndarray:
    """Symbols of a text; words are SPAN - 1 zeros apart, so that no triple reaches across.

    A blank between two single characters is a gap within a word: spelled-out words are one word.
    """
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.where(points < 0x3000, _fold()[np.minimum(points, 0x2FFF)], 37 + points % 25).astype(np.uint8)
    s = np.concatenate([[0, 0], s, [0, 0]]).astype(np.uint8)
    blank = s == 0
    inner = np.zeros(len(s), dtype=bool)
    i = np.flatnonzero(blank[2:-2]) + 2
    inner[i] = blank[i - 2] & blank[i + 2] & ~blank[i - 1] & ~blank[i + 1]
    s[inner] = GAP
    return np.repeat(s, np.where(s == 0, SPAN - 1, 1))


def starts(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero((s[1:] > 0) & (s[:-1] == 0)) + 1


@cache
def _scale() -> np.ndarray:
    """1 / norm of a word by its number of letters: the norm if all its triples were different."""
    n = np.arange(256)
    square = sum(np.maximum(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in PATTERNS)
    return (1 / np.sqrt(np.maximum(square, DECAY ** 6))).astype(np.float32)


def word_scores(text: str, table: np.ndarray) -> np.ndarray:
    """Score of each word of a text under a table of triple weights, without the bias."""
    s = symbols(text)
    at = starts(s)
    if not len(at):
        return np.zeros(0, dtype=np.float32)
    high, mid, low = s.astype(np.int32) << 12, s.astype(np.int32) << 6, s.astype(np.int32)
    sums = np.zeros(len(s), dtype=np.float32)
    for a, b in PATTERNS:
        n = len(s) - b
        sums[:n] += table[high[:n] + mid[a:a + n] + low[b:]] * np.float32(DECAY ** (b + 1))
    letters = np.add.reduceat(((s > 0) & (s != GAP)).astype(np.int32), at)
    return np.add.reduceat(sums, at) * _scale()[np.minimum(letters, 255)]


def _triples(word: str) -> dict[int, float]:
    """Triples of a word with their scaled weights."""
    s = symbols(word)
    s = s[s > 0].astype(np.int64)
    out: dict[int, float] = {}
    scale = float(_scale()[min(255, int((s != GAP).sum()))])
    for a, b in PATTERNS:
        for i in range(len(s) - b):
            if GAP not in (t := (s[i], s[i + a], s[i + b])):
                code = int(t[0] << 12 | t[1] << 6 | t[2])
                out[code] = out.get(code, 0.0) + DECAY ** (b + 1) * scale
    return out


def _kernel(words: list[dict[int, float]], marks: list[dict[int, float]]) -> np.ndarray:
    codes = {c: i for i, c in enumerate(sorted({c for m in marks for c in m}))}
    dense = np.zeros((len(codes), len(marks)))
    for j, m in enumerate(marks):
        for c, v in m.items():
            dense[codes[c], j] = v
    out = np.zeros((len(words), len(marks)))
    for i, w in enumerate(words):
        hit = [(codes[c], v) for c, v in w.items() if c in codes]
        if hit:
            k, v = zip(*hit)
            out[i] = np.array(v) @ dense[list(k)]
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss (last: bias), by Newton steps on its active set."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (z @ w) < 1
        za, ca = z[active], c * weight[active]
        new = np.linalg.solve(ridge + (za * ca[:, None]).T @ za, (za * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, eye = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(scores: np.ndarray, bias: float) -> list[float]:
    """The two worst words of a text; a text without words looks like words that share nothing with any insult."""
    top = np.sort(scores)[-2:][::-1] if len(scores) else np.zeros(0)
    top = np.concatenate([top, np.zeros(2 - len(top))]) + bias
    return [float(top[0]), float(top[1]), float(np.log1p(len(scores)))]


class Model:
    """A table of triple weights, its bias and the weights from the worst words of a text to a chance."""

    def __init__(self, table: np.ndarray, bias: float, link: np.ndarray):
        self.table, self.bias, self.link = table, bias, link

    def score(self, text: str) -> float:
        x = _features(word_scores(text, self.table), self.bias)
        return float(1 / (1 + np.exp(-np.clip(np.dot([*x, 1.0], self.link), -30, 30))))


def _first_table(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Log odds of ungapped triples by how many texts of either label have them."""
    seen = np.zeros((2, SYMBOLS ** 3), dtype=np.float32)
    for text, label in zip(texts, toxic):
        s = symbols(text).astype(np.int64)
        codes = np.unique(s[:-2] << 12 | s[1:-1] << 6 | s[2:])
        seen[int(label), codes] += 1
    n = np.bincount(toxic.astype(int), minlength=2) + 1.0
    table = np.log((seen[1] + 0.5) / n[1]) - np.log((seen[0] + 0.5) / n[0])
    codes = np.arange(SYMBOLS ** 3)
    bare = ((codes >> 12) % GAP == 0) | ((codes >> 6 & 63) % GAP == 0) | ((codes & 63) % GAP == 0)
    table[bare | (seen.sum(axis=0) == 0)] = 0
    return table.astype(np.float32)


def fit(texts: list[str], toxic: list[bool]) -> Model:
    """Fit on labelled texts. Without texts of both labels, scores are the share of toxic texts (or 0)."""
    y = np.array(toxic, dtype=bool)
    rate = float(y.mean()) if len(y) else 0.0
    if not y.any() or y.all():
        odds = np.log((rate + 1e-9) / (1 - rate + 1e-9))
        return Model(np.zeros(SYMBOLS ** 3, dtype=np.float32), 0.0, np.array([0.0, 0.0, 0.0, odds]))
    table, bias = _first_table(texts, y), 0.0
    split = [_words(t) for t in texts]
    for _ in range(ROUNDS):
        good, bad = {}, {}
        for words, text, label in zip(split, texts, y):
            scores = word_scores(text, table)
            for k in np.argsort(-scores)[:WORST]:
                (bad if label else good).setdefault(words[k], 0)
                (bad if label else good)[words[k]] += 1
            if not label:
                for k in range(0, len(words), max(1, len(words) // WORST)):
                    good.setdefault(words[k], 0)
        negative = sorted(good, key=lambda w: (-good[w], w))[:6000]
        # A word that clean texts have as well is not to blame.
        positive = [w for w in sorted(bad, key=lambda w: (-bad[w], w)) if w not in good][:3000]
        if not positive or not negative:
            break
        bent = [b for w in positive[:600] for b in _bent(w)]
        marks = [_triples(w) for w in positive[:LANDMARKS * 3 // 4] + negative[:LANDMARKS // 4]]
        features = [_triples(w) for w in positive + bent + negative]
        label = np.array([1.0] * (len(positive) + len(bent)) + [-1.0] * len(negative))
        often = np.array([min(5, bad[w]) for w in positive] + [0.5] * len(bent) + [1 + min(5, good[w]) for w in negative], dtype=float)
        values, vectors = np.linalg.eigh(_kernel(marks, marks))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        w = _svm(_kernel(features, marks) @ root, label, often / often.mean())
        beta, bias = root @ w[:-1], float(w[-1])
        table = np.zeros(SYMBOLS ** 3, dtype=np.float32)
        for b, m in zip(beta, marks):
            for code, v in m.items():
                table[code] += b * v
    link = _logistic(np.array([_features(word_scores(t, table), bias) for t in texts]), y.astype(float))
    return Model(table, bias, link)


def _words(text: str) -> list[str]:
    """The words whose scores word_scores gives, as strings of symbols' letters."""
    s = symbols(text)
    at = starts(s)
    letters = "".join(chr(96 + v) if 0 < v < 27 else "." if v == GAP else " " if v == 0 else chr(0x100 + v) for v in s.tolist())
    return [letters[a:].split(" ", 1)[0] if b is None else letters[a:b].rstrip(" ") for a, b in zip(at.tolist(), [*at.tolist()[1:], None])]


def _bent(word: str) -> Iterator[str]:
    """A word with one letter inserted, and with dots between its letters."""
    middle = len(word) // 2
    yield word[:middle] + "xzqjkvw"[len(word) % 7] + word[middle:]
    yield ".".join(word)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` toxic and twice as many other texts that aren't held out, by the smallest hash of the id.

    A text is toxic if any of its labels says so; null labels are no labels. Texts over SAMPLE_CHARS characters are not
    fitted on (they are scored). The sample is collected: its size has this bound at any size of the tables.
    """
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [marked.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((False, 2 * sample), (True, sample))]
    chosen = chosen[0].union(chosen[1])
    rows = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(order, "doc_id", "text").limit(3 * sample).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def scored(text: Column, model: Model) -> Column:
    """Chance that a text is toxic; null counts as an empty text."""
    shared = _spark().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype="float64")

    return f(F.coalesce(text, F.lit("")))


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column toxicity (0 to 1). Every row comes back once; texts are scored whole, where they are read."""
    model = train(docs, labels, sample)
    return docs.withColumn("toxicity", scored(F.col("text"), model))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
