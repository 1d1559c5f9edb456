"""Word shingles for exact set-similarity search: a global rare-first order, prefixes under it, exact verification.

Any order of shingles that is the same for all texts gives exact prefixes; only the speed depends on it. The order here
comes from two tables of bounded size: words that make up at least 1/20,000 of all words, and shingles that make up at
least 1/50,000 of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.scratch import materialise

WORDS_KEPT = 20_000
SHINGLES_KEPT = 50_000
HOT_SHINGLE = 100_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Shape:
    """k words a shingle; two texts are near when |common| / |either| is at least `least` (a decimal, taken exactly).

    hits: how many shingles the prefixes of near texts must share. If texts of m and n shingles share c >= needed(m, n), the
    first `hits` of them lie at ranks with at least needed - hits + 1 shingles from there on, in both; so longer prefixes
    with more shared shingles lose no pair, and single chance matches are no candidates.
    """

    k: int = 5
    least: str = "0.8"
    hits: int = 3

    @property
    def ratio(self) -> Fraction:
        return Fraction(self.least)

    def prefix(self, m: np.ndarray) -> np.ndarray:
        """Of m distinct shingles in rare-first order, how many must be looked at."""
        r = self.ratio
        return m - -(-m * r.numerator // r.denominator) + self.hits

    def needed(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Common shingles that texts of m and n shingles need."""
        r = self.ratio
        top, low = r.numerator, r.numerator + r.denominator
        return -(-(m + n) * top // low)


@dataclass(frozen=True)
class Order:
    """Sorted hashes of frequent words and shingles, and how frequent they are (log2). total: shingles of all texts, with repeats."""

    words: np.ndarray
    word_logs: np.ndarray
    word_rest: float
    grams: np.ndarray
    gram_logs: np.ndarray
    total_words: int
    total: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Encoded:
    """The words of a batch of word texts, as one concatenated array of hashes."""

    def __init__(self, texts: list[str], k: int) -> None:
        parts = [t.split(" ") if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        codes: dict[str, int] = {}
        index = np.fromiter((codes.setdefault(w, len(codes)) for w in flat), np.int64, len(flat))
        self.unique = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes))
        self.index = index
        self.word = self.unique[index] if len(flat) else np.zeros(0, np.uint64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(parts)), lengths)
        self.end = ends[owner] if len(flat) else np.zeros(0, np.int64)
        self.at = np.flatnonzero(np.arange(len(flat)) + k <= self.end)
        self.owner = owner[self.at]
        gram = np.zeros(len(self.at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                gram = _mixed(gram * np.uint64(0x9E3779B97F4A7C15) + self.word[self.at + j])
        self.gram = gram


class FrequentItems:
    """Counts of hashed items of a stream in bounded memory: at most `kept` counters, and no count too low by more than 1/kept of
    all items seen, so whatever makes up more than that share is there."""

    def __init__(self, kept: int) -> None:
        self.kept, self.total = kept, 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.total += int(n.sum())
        every, at = np.unique(np.r_[self.h, h], return_inverse=True)
        sums = np.bincount(at, np.r_[self.n, n], len(every)).astype(np.int64)
        if len(every) > self.kept:  # all counts fall by that of the first one without a place
            sums = sums - np.partition(sums, -self.kept - 1)[-self.kept - 1]
        self.h, self.n = every[sums > 0], sums[sums > 0]

    def kept_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Without what makes up no more than 1/kept of this stream: that takes no count further down than the bound on all."""
        often = self.n > self.total // self.kept
        return self.h[often], self.n[often]


def _count_batches(k: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, grams = FrequentItems(4 * WORDS_KEPT), FrequentItems(4 * SHINGLES_KEPT)
        for pdf in batches:
            e = Encoded(pdf["words"].tolist(), k)
            words.add(e.unique, np.bincount(e.index, minlength=len(e.unique)))
            grams.add(*np.unique(e.gram, return_counts=True))
        (w, n_w), (g, n_g) = words.kept_counts(), grams.kept_counts()
        yield pd.DataFrame(
            {
                "kind": np.r_[np.zeros(len(w)), np.ones(len(g)), [2, 3]].astype(np.int32),
                "h": np.r_[w, g, np.zeros(2, np.uint64)].astype(np.uint64).astype(np.int64),
                "n": np.r_[n_w, n_g, [words.total, grams.total]].astype(np.int64),
            }
        )

    return count


def rare_first(texts: DataFrame, words: str, k: int) -> Order:
    """The order for a collection of word texts. Counts are kept by task and added up, each too low by half of the least share
    looked for at most, so every word of 1/20,000 and every shingle of 1/50,000 of all is found. What comes to the driver is at most
    40,000 words and 100,000 shingles: no more can make up half of that share."""
    counts = materialise(texts.select(F.col(words).alias("words")).mapInPandas(_count_batches(k), "kind int, h bigint, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("kind >= 2").groupBy().agg(F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("w"), F.sum(F.when(F.col("kind") == 3, F.col("n"))).alias("g"))
    least = F.when(F.col("kind") == 0, F.col("w") / (2 * WORDS_KEPT)).otherwise(F.col("g") / (2 * SHINGLES_KEPT))
    kept = counts.where("kind < 2").crossJoin(F.broadcast(total)).where(F.col("n") >= least).select("kind", "h", "n").unionByName(counts.where("kind >= 2"))
    return _as_order(kept.toPandas())


def _as_order(kept: pd.DataFrame) -> Order:
    sides = []
    for kind in (0, 1):
        one = kept[kept["kind"] == kind]
        h = one["h"].to_numpy(np.int64).astype(np.uint64)
        o = np.argsort(h)
        sides.append((h[o], np.log2(one["n"].to_numpy(np.float64)[o] + 1.0)))
    words, grams = (int(kept.loc[kept["kind"] == kind, "n"].sum()) for kind in (2, 3))
    floor = float(np.log2(max(1.0, words / WORDS_KEPT / 4)))
    return Order(sides[0][0], sides[0][1], floor, sides[1][0], sides[1][1], words, grams)


def write_order(spark: SparkSession, order: Order, path: str) -> None:
    counts = lambda logs: np.round(np.exp2(logs) - 1.0).astype(np.int64)
    rows = pd.DataFrame(
        {
            "kind": np.r_[np.zeros(len(order.words)), np.ones(len(order.grams)), [2, 3]].astype(np.int32),
            "h": np.r_[order.words, order.grams, np.zeros(2, np.uint64)].astype(np.uint64).astype(np.int64),
            "n": np.r_[counts(order.word_logs), counts(order.gram_logs), [order.total_words, order.total]].astype(np.int64),
        }
    )
    spark.createDataFrame(rows, "kind int, h bigint, n bigint").write.parquet(path)


def read_order(spark: SparkSession, path: str) -> Order:
    return _as_order(spark.read.parquet(path).toPandas())


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, rest: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), rest)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], rest)


@dataclass
class Prefixes:
    """The prefix shingles of a batch: which text, of how many distinct shingles, at which rank, hash, and place in the batch."""

    owner: np.ndarray
    size: np.ndarray
    rank: np.ndarray
    gram: np.ndarray
    at: np.ndarray
    encoded: Encoded


def prefixes(texts: list[str], shape: Shape, order: Order) -> Prefixes:
    e = Encoded(texts, shape.k)
    logs = _lookup(order.words, order.word_logs, e.unique, order.word_rest)[e.index] if len(e.index) else np.zeros(0)
    score = np.zeros(len(e.at))
    for j in range(shape.k):
        score += logs[e.at + j]
    known = _lookup(order.grams, order.gram_logs, e.gram, -1.0)
    rank = np.where(known >= 0, 1e6 + known, score)
    rank = np.floor(rank * 64).astype(np.int64)
    o = np.lexsort((e.gram, rank, e.owner))
    owner, gram, at = e.owner[o], e.gram[o], e.at[o]
    new = np.ones(len(o), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, gram, at = owner[new], gram[new], at[new]
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - starts[owner]
    kept = place < shape.prefix(sizes[owner])
    owner = owner[kept]
    return Prefixes(owner, sizes[owner], place[kept], gram[kept], at[kept], e)


def prefix_table(texts: DataFrame, text_id: str, words: str, shape: Shape, order: Order, probing: bool) -> DataFrame:
    """(tid, size, rank, gram, salt): the prefix of each word text; texts of fewer than k words have none.

    A shingle that more than 100,000 texts hold is cut into so many pieces that each has no more: an entry of the probing side goes to one
    of them, one of the other side to all.
    """
    counts = np.exp2(order.gram_logs)
    hot = counts > HOT_SHINGLE
    hot_grams, pieces = order.grams[hot], np.ceil(counts[hot] / HOT_SHINGLE)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = prefixes(pdf["words"].tolist(), shape, order)
            tid = pdf["tid"].to_numpy()[p.owner]
            out = pd.DataFrame({"tid": tid, "size": p.size.astype(np.int32), "rank": p.rank.astype(np.int32), "gram": p.gram.astype(np.int64), "salt": np.int32(0)})
            spread = _lookup(hot_grams, pieces, p.gram, 1.0).astype(np.int64)
            if probing:
                out["salt"] = (tid % spread).astype(np.int32)
            elif (spread > 1).any():
                which = np.repeat(np.arange(len(out)), spread)
                out = out.iloc[which].reset_index(drop=True)
                out["salt"] = (np.arange(len(which)) - np.repeat(np.cumsum(spread) - spread, spread)).astype(np.int32)
            yield out

    return texts.select(F.col(text_id).alias("tid"), F.col(words).alias("words")).mapInPandas(emit, "tid bigint, size int, rank int, gram bigint, salt int")


def could_match(shape: Shape, size_a: Column, rank_a: Column, size_b: Column, rank_b: Column) -> Column:
    """Length and position filters on a shared shingle: whether it can be one of the first `hits` that near texts share."""
    r = shape.ratio
    top, low = F.lit(r.numerator), F.lit(r.denominator)
    lengths = (F.least(size_a, size_b) * low) >= (F.greatest(size_a, size_b) * top)
    rest = F.least(size_a - rank_a, size_b - rank_b) + (shape.hits - 1)
    return lengths & (rest * F.lit(r.numerator + r.denominator) >= (size_a + size_b) * top)


def enough(shape: Shape, shared: Column, size_a: Column, size_b: Column) -> Column:
    """Whether prefixes share enough shingles: `hits`, or all that are needed where that is less."""
    r = shape.ratio
    return (shared >= shape.hits) | (shared * F.lit(r.numerator + r.denominator) >= (size_a + size_b) * F.lit(r.numerator))


def near(shape: Shape):
    """UDF: whether two word texts are near by their shingles as strings, without hashes."""
    k, top, low = shape.k, shape.ratio.numerator, shape.ratio.denominator

    def grams(text: str) -> set:
        w = text.split(" ")
        return set(zip(*(w[j:] for j in range(k)), strict=False))

    @F.pandas_udf(T.BooleanType())
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = grams(x), grams(y)
            both = len(p & q)
            out.append(both > 0 and both * low >= (len(p) + len(q) - both) * top)
        return pd.Series(out, dtype=bool)

    return check
