"""Problem 5: duplicates hidden by formatting differences.

Code points pass a skip-and-fold table (separator or folded letter) into two polynomial hashes of the fields; nothing
canonical is ever built. Rows whose hashes agree with the first of their group are compared with it by two pointers
that skip separators.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm import common

# Two primes below 2^31 and a base for each; residues multiply within 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SEPARATOR = 1
POWERS_KEPT = 1 << 16
HOT_CLASS = 100_000


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point -> 0 for what only separates words, else a code above SEPARATOR that equal letters share."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            table[cp] = (ord(low) if len(low) == 1 else cp) + SEPARATOR + 1
    return table


@lru_cache(2)
def _powers(which: int) -> np.ndarray:
    p, b = PRIMES[which], BASES[which]
    out = np.empty(POWERS_KEPT, np.uint64)
    x = 1
    for i in range(POWERS_KEPT):
        out[i] = x
        x = x * b % p
    return out


def _power_at(which: int, at: np.ndarray) -> np.ndarray:
    """base^at mod prime; long texts combine a power of base^65536 with a kept one."""
    kept = _powers(which)
    if not len(at) or int(at.max()) < POWERS_KEPT:
        return kept[at]
    p, b = PRIMES[which], BASES[which]
    high, step = at // POWERS_KEPT, pow(b, POWERS_KEPT, p)
    far = np.array([pow(step, h, p) for h in range(int(high.max()) + 1)], np.uint64)
    return far[high] * kept[at % POWERS_KEPT] % np.uint64(p)


def layout_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, words): a 62-bit hash of each text's sequence of words, and whether it holds a word."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    owner = np.repeat(np.arange(n), lengths)
    folded = fold_table()[np.minimum(codes, 0x10FFFF)]
    kept = folded != 0
    at = np.flatnonzero(kept)
    if not len(at):
        return np.zeros(n, np.int64), np.zeros(n, bool)
    owner = owner[at]
    first = np.empty(len(at), bool)
    first[0] = True
    first[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])  # a word begins here
    # every word is led by one separator: its place in the stream is its own index plus the words begun so far
    place = np.arange(len(at)) + np.cumsum(first)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    base_of = np.repeat(place[starts] - 1, np.diff(np.r_[starts, len(at)]))
    place = place - base_of
    values = folded[at].astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for which, p in enumerate(PRIMES):
        prime = np.uint64(p)
        power = _power_at(which, place)
        terms = values * power % prime
        terms[first] += np.uint64(SEPARATOR) * _power_at(which, place[first] - 1)
        sums = np.add.reduceat(terms, starts) % prime
        out[owner[starts]] = (out[owner[starts]] << np.uint64(31)) | sums
    has = np.zeros(n, bool)
    has[owner[starts]] = True
    return out.astype(np.int64), has


def _kept(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded letters, where each stands) of a text without what only separates words."""
    folded = fold_table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10FFFF)]
    at = np.flatnonzero(folded)
    return folded[at], at


def same_layout_free(a: str, b: str) -> bool:
    """Two pointers over a and b that skip separators, moved on together as arrays of places: whether the sequences of words are equal,
    letter by letter, with a gap after the same letters."""
    if a == b:
        return True
    (x, i), (y, j) = _kept(a), _kept(b)
    return len(x) == len(y) and bool((x == y).all()) and bool(((np.diff(i) > 1) == (np.diff(j) > 1)).all())


def read_lines(df: DataFrame, line_id: str, raw: str, fields: list[str]) -> DataFrame:
    """(id, *fields) of the lines that are one JSON object; others, and null ids, are left out. A field that isn't a string is null."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = [], []
            for i, line in zip(pdf["id"], pdf["raw"], strict=True):
                try:
                    value = json.loads(line)
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    ids.append(i)
                    rows.append([v if isinstance(v := value.get(f), str) else None for f in fields])
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64")} | {f: pd.Series([r[k] for r in rows], dtype=object) for k, f in enumerate(fields)})

    plain = df.select(F.col(line_id).cast("bigint").alias("id"), F.col(raw).cast("string").alias("raw")).where("id is not null and raw is not null")
    return plain.mapInPandas(parse, "id bigint, " + ", ".join(f"`{f}` string" for f in fields))


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h1, w1 = layout_hashes(pdf["a"].tolist())
        h2, w2 = layout_hashes(pdf["b"].tolist())
        yield pd.DataFrame({"id": pdf["id"], "h1": h1, "h2": h2})[w1 & w2]


def _plain(records: DataFrame, record_id: str, field_a: str, field_b: str) -> DataFrame:
    return records.select(F.col(record_id).cast("bigint").alias("id"), F.col(field_a).cast("string").alias("a"), F.col(field_b).cast("string").alias("b")).where("id is not null and a is not null and b is not null")


def _hashed(plain: DataFrame) -> DataFrame:
    return common.materialise(plain.mapInPandas(_hash_batches, "id bigint, h1 bigint, h2 bigint").distinct(), "layout")


def _members(left: DataFrame) -> DataFrame:
    """(id, h1, h2, first_id, salts): rows that share their hashes with a smaller id, and into how many pieces their class is cut. Classes of
    more than 100,000 rows are joined by broadcast: there can't be more than one for each 100,000 rows."""
    groups = common.materialise(left.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "classes")
    groups = groups.select("h1", "h2", "first_id", F.ceil(F.col("n") / HOT_CLASS).cast("int").alias("salts"))
    hot = groups.where("salts > 1")
    members = left.join(groups.where("salts = 1"), ["h1", "h2"])
    if not hot.isEmpty():
        hot = F.broadcast(hot)
        members = left.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(groups.where("salts = 1"), ["h1", "h2"]).unionByName(left.join(hot, ["h1", "h2"]))
    return common.materialise(members.where("id <> first_id"), "members")


def _copies(plain: DataFrame, hashed: DataFrame) -> DataFrame:
    found, left = None, hashed
    while True:
        members = _members(left)
        # a class's first text goes to each of its pieces, so a class of any size is compared by many tasks
        firsts = members.groupBy("first_id").agg(F.max("salts").alias("salts"))
        wanted = members.select("id").union(firsts.select("first_id"))
        texts = common.materialise(plain.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts")
        firsts = firsts.join(texts.select(F.col("id").alias("first_id"), F.col("a").alias("fa"), F.col("b").alias("fb")), "first_id")
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        pairs = members.join(texts, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).join(firsts, ["first_id", "salt"])
        checked = common.materialise(pairs.select("id", "h1", "h2", "first_id", _same_both("a", "fa", "b", "fb").alias("same")), "checked")
        good = checked.where("same").select("first_id", F.col("id").alias("copy_id"))
        found = good if found is None else found.union(good)
        left = checked.where("not same").select("id", "h1", "h2")
        if left.isEmpty():  # true unless 124 bits of hash collide: then what differs is grouped again
            return found


def layout_copies(records: DataFrame, record_id: str, field_a: str, field_b: str) -> DataFrame:
    """(first_id, copy_id): records whose two fields hold equal sequences of words; first_id is the smallest id of the group.

    Records with a null id, or with no word in one of the fields (null, empty, only signs), are left out. A repeated row
    (same id) is one record. Texts are read whole; empty tables give no row.
    """
    plain = _plain(records, record_id, field_a, field_b)
    return _copies(plain, _hashed(plain))


@F.pandas_udf(T.BooleanType())
def _same_both(a: pd.Series, fa: pd.Series, b: pd.Series, fb: pd.Series) -> pd.Series:
    return pd.Series([same_layout_free(w, x) and same_layout_free(y, z) for w, x, y, z in zip(a, fa, b, fb, strict=True)], dtype=bool)


def layout_groups(records: DataFrame, record_id: str, field_a: str, field_b: str) -> DataFrame:
    """(first_id, copies): one row for every record left after collapsing, with the number of its copies, itself included."""
    plain = _plain(records, record_id, field_a, field_b)
    hashed = _hashed(plain)
    copies = common.materialise(_copies(plain, hashed), "copies")
    counted = copies.groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
    alone = hashed.select("id").distinct().join(copies.select(F.col("copy_id").alias("id")), "id", "left_anti")
    return alone.join(counted, F.col("id") == F.col("first_id"), "left").select(F.col("id").alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
