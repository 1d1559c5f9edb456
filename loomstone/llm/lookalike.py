"""Problem 10: visually identical text with different characters.

Look-alike classes are built by union-find over strings (single code points, base + accent sequences, the empty
string for what can't be seen). Every class gets the member that the collection uses most as its representative, and an
Aho-Corasick automaton rewrites texts greedily, longest match first.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import common

# Letters of other alphabets drawn like a Latin letter (pairs of letter and Latin letter).
LOOKALIKE_LETTERS = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl ԛq ԝw ѵv "  # Cyrillic, small
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ӀI ԌG ԚQ ԜW "  # Cyrillic, capital
    "οo νv ρp ιi ϳj "  # Greek, small
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ͿJ "  # Greek, capital
    "ɡg օo հh ոn ցg ՕO ՏS"  # script g, Armenian
)
# Hyphens that are non-breaking or of another width than the ASCII hyphen.
HYPHENS = "‐‑‒⁃﹣－"
# Code points outside category Cf that are not drawn, as ranges.
IGNORED_RANGES = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Format characters that are drawn, as ranges.
DRAWN_FORMATS = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))

FORM_SCHEMA = "id bigint, text_key string, form_key string"


class UnionFind:
    """Disjoint sets of strings, with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[b] = a

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values() if len(g) > 1]


def _within(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@lru_cache(1)
def base_classes() -> tuple[tuple[str, ...], ...]:
    """Classes of single code points (and the empty string), by rule from the Unicode character data."""
    sets = UnionFind()
    for pair in LOOKALIKE_LETTERS.split():
        sets.union(pair[1], pair[0])
    for h in HYPHENS:
        sets.union("-", h)
    for cp in range(0x80, 0x110000):
        if 0x3400 <= cp < 0xFB00 or 0x20000 <= cp < 0xE0000:
            continue  # ideographs, Hangul, surrogates, private use: nothing of the kinds below
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            sets.union(" ", ch)
        elif kind == "Cf" and not _within(cp, DRAWN_FORMATS) or _within(cp, IGNORED_RANGES):
            sets.union("", ch)
        else:
            form = unicodedata.decomposition(ch).split()
            if len(form) == 2 and form[0] in ("<wide>", "<narrow>"):
                sets.union(chr(int(form[1], 16)), ch)
    return tuple(tuple(c) for c in sets.classes())


@lru_cache(1)
def accent_classes() -> tuple[tuple[str, ...], ...]:
    """Classes of accented letters: the composed letter, and every look-alike base followed by its accents."""
    like: dict[str, list[str]] = {x: list(c) for c in base_classes() for x in c}
    sets = UnionFind()
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) < 2 or not all(unicodedata.combining(m) for m in parts[1:]):
            continue
        for base in like.get(parts[0], [parts[0]]):
            sets.union(ch, base + parts[1:])
            composed = unicodedata.normalize("NFC", base + parts[1:])
            sets.union(ch, composed)
            for cut in range(1, len(parts) - 1):  # partly composed, as é + a second accent
                sets.union(ch, unicodedata.normalize("NFC", base + parts[1 : cut + 1]) + parts[cut + 1 :])
    return tuple(tuple(c) for c in sets.classes())


def choose(classes: tuple[tuple[str, ...], ...], used: dict[str, int]) -> dict[str, str]:
    """string -> representative: the member used most; ties go to the shortest, then the lowest in code point order."""
    out = {}
    for members in classes:
        if "" in members:
            best = ""
        else:
            best = min(members, key=lambda m: (-used.get(m, 0), len(m), m))
        out.update({m: best for m in members if m != best and m})
    return out


class Rewriter:
    """Rewrites text in two greedy leftmost-longest passes: single characters, then base + accent sequences.

    After the first pass only representatives of the base classes are left, so the second needs no sequence that holds
    anything else.
    """

    def __init__(self, used: dict[str, int] | None = None) -> None:
        singles = choose(base_classes(), used or {})
        sequences = choose(accent_classes(), used or {})
        self.first = self._automaton(singles)
        self.second = self._automaton({s: best for s, best in sequences.items() if not any(ch in singles for ch in s)})

    @staticmethod
    def _automaton(rules: dict[str, str]) -> ahocorasick.Automaton | None:
        if not rules:
            return None
        a = ahocorasick.Automaton()
        for s, to in rules.items():
            a.add_word(s, (len(s), to))
        a.make_automaton()
        return a

    @staticmethod
    def _pass(text: str, automaton: ahocorasick.Automaton | None) -> str:
        if automaton is None:
            return text
        out, at = [], 0
        for end, (length, to) in automaton.iter_long(text):
            start = end + 1 - length
            out.append(text[at:start])
            out.append(to)
            at = end + 1
        if not out:
            return text
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text if self._ascii_fixed else self._rewrite(text)
        return self._rewrite(text)

    @property
    def _ascii_fixed(self) -> bool:
        """Whether no ASCII character is ever rewritten (so for every usual collection)."""
        if not hasattr(self, "_fixed"):
            probe = "".join(map(chr, range(128)))
            self._fixed = self._rewrite(probe) == probe
        return self._fixed

    def _rewrite(self, text: str) -> str:
        return self._pass(unicodedata.normalize("NFC", self._pass(text, self.first)), self.second)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    singles = {ord(x) for c in base_classes() for x in c if len(x) == 1} | {ord(x) for c in accent_classes() for x in c if len(x) == 1}
    wanted = np.zeros(0x110000, bool)
    wanted[list(singles)] = True
    total = np.zeros(0x110000, np.int64)
    pairs = {x: 0 for c in accent_classes() for x in c if len(x) == 2}
    marks = np.zeros(0x110000, bool)
    marks[0x300:0x370] = True
    for pdf in batches:
        codes = np.frombuffer("\n".join(t for t in pdf["text"] if t).encode("utf-32-le", "replace"), np.uint32)
        if not len(codes):
            continue
        total += np.bincount(codes, minlength=0x110000)
        for i in np.flatnonzero(marks[codes]):
            if i:
                s = chr(codes[i - 1]) + chr(codes[i])
                if s in pairs:
                    pairs[s] += 1
    found = np.flatnonzero(wanted & (total > 0))
    pairs = {s: n for s, n in pairs.items() if n}
    pieces = [chr(c) for c in found] + list(pairs)
    yield pd.DataFrame({"piece": pd.Series(pieces, dtype=object), "n": pd.Series([int(total[c]) for c in found] + list(pairs.values()), dtype="int64")})


def usage(df: DataFrame, text: str) -> dict[str, int]:
    """How often each member of a class occurs: single characters, and pairs of letter and accent. Nothing else is counted, so
    what comes to the driver is bounded by the classes (some thousand strings)."""
    parts = df.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInPandas(_count_batches, "piece string, n bigint")
    rows = parts.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    return {p: int(n) for p, n in zip(rows["piece"], rows["n"], strict=True)}


def canonical_forms(df: DataFrame, doc_id: str, text: str, out: str = "form", used: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, out): the one form of every text.

    A null text has a null form, an empty one an empty form. Texts of any length are rewritten whole. Repeated rows stay
    repeated. Other columns of df are not looked at, whatever their names.
    """
    used = usage(df, text) if used is None else used

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter(used)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "form": pd.Series([None if t is None else rewriter(t) for t in pdf["text"]], dtype=object)})

    plain = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInPandas(rewrite, f"id {kind}, form string").select(F.col("id").alias(doc_id), F.col("form").alias(out))


def form_keys(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text_key, form_key): 128-bit digests of the text and of its one form; rows with a null id or text are left out."""
    used = usage(df, text)

    def digest(s: str) -> str:
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter(used)
        for pdf in batches:
            text_keys, form_keys = [digest(t) for t in pdf["text"]], [digest(rewriter(t)) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "text_key": pd.Series(text_keys, dtype=object), "form_key": pd.Series(form_keys, dtype=object)})

    plain = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    return plain.mapInPandas(keys, FORM_SCHEMA)


def _shared_forms(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text_key, form_key, first_id, n_texts, n_docs) of the documents whose form is that of at least two different texts, written."""
    keys = common.materialise(form_keys(df, doc_id, text).distinct(), "forms")
    texts = keys.groupBy("form_key", "text_key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    forms = texts.groupBy("form_key").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_docs"), F.min("id").alias("first_id")).where("n_texts > 1")
    return common.materialise(keys.join(forms, "form_key"), "shared-forms")


def lookalike_groups(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, first_id, n_texts, n_docs) of the documents whose form is shared by at least two different texts: the class of each
    by its smallest id, and how many texts and documents are in it.

    Rows with a null id or text are left out; a repeated row counts once. Empty tables give no row.
    """
    return _shared_forms(df, doc_id, text).select(F.col("id").alias(doc_id), "first_id", "n_texts", "n_docs")


def lookalike_pairs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents with different texts of one form.

    The classes of lookalike_groups, expanded: different texts of a form are paired first, then their documents, so
    copies of one text are never paired with each other. Nulls as in lookalike_groups.
    """
    keys = _shared_forms(df, doc_id, text).select("id", "form_key", "text_key")
    texts = keys.select("form_key", "text_key").distinct()
    pairs = texts.alias("a").join(texts.alias("b"), "form_key").where("a.text_key < b.text_key").select("form_key", F.col("a.text_key").alias("key_a"), F.col("b.text_key").alias("key_b"))
    one = keys.select("form_key", F.col("text_key").alias("key_a"), F.col("id").alias("id_a"))
    two = keys.select("form_key", F.col("text_key").alias("key_b"), F.col("id").alias("id_b"))
    both = pairs.join(one, ["form_key", "key_a"]).join(two, ["form_key", "key_b"]).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()
