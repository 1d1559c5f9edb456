"""Problem 4: token budget per source and language, under a public byte-level BPE vocabulary.

Texts are cut by the tokenizer's pattern into pieces. The distinct pieces of a batch are stored as arrays of symbols; all
adjacent pairs are joined with the merge ranks at once (a binary search in the sorted table of pairs), every piece applies its
lowest-ranked merge, and this is repeated until no piece changes. What is left of a piece is its number of tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("LOOMSTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PIECES_KEPT = 200_000


class MergeTable:
    """The merges of a rank file: every token of two or more bytes is the merge of two tokens, its parts under the ranks below it."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = np.int64(max(ranks.values()) + 1)
        pairs = []
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._parts(token, ranks, rank)
                if len(parts) == 2:
                    pairs.append((ranks[parts[0]] * int(self.base) + ranks[parts[1]], rank))
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r in pairs], np.int64)

    @staticmethod
    def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], below)) < below]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece."""
        n = len(pieces)
        data = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, data), np.int64, n)
        symbols = self.bytes[np.frombuffer(b"".join(data), np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        out = lengths.copy()
        none = np.int64(1) << np.int64(40)
        while len(symbols) > 1:
            keys = symbols[:-1] * self.base + symbols[1:]
            slot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = (self.pairs[slot] == keys) & (owner[:-1] == owner[1:])
            rank = np.where(hit, self.ranks[slot], none)
            # pieces without a merge are done
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            open_piece = lowest < none
            out[owner[starts]] = sizes
            if not open_piece.any():
                break
            best = np.repeat(lowest, sizes)
            take = np.flatnonzero(hit & (rank == best[:-1]))
            # overlapping pairs of one rank (aaa): the leftmost first, then every second
            if len(take) > 1:
                run = np.r_[True, take[1:] != take[:-1] + 1]
                first = np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))
                take = take[(np.arange(len(take)) - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[take] = rank[take]
            kept = np.repeat(open_piece, sizes)
            kept[take + 1] = False
            symbols, owner = symbols[kept], owner[kept]
        if len(symbols) == 1:
            out[owner] = 1
        return out


class Counter:
    """Tokens of texts. Distinct pieces are merged once; up to 200,000 of them are remembered (a new set is begun beyond)."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.known = table, {}
        self.cut = regex.compile(PATTERN).findall

    def count(self, texts: list[str | None]) -> list[int | None]:
        if len(self.known) > PIECES_KEPT:
            self.known = {}
        known = self.known
        cut = [None if t is None else self.cut(t) for t in texts]
        new = list({p for pieces in cut if pieces for p in pieces if p not in known})
        if new:
            known.update(zip(new, self.table.counts(new).tolist(), strict=True))
        get = known.__getitem__
        return [None if pieces is None else sum(map(get, pieces)) for pieces in cut]


def token_counts(df: DataFrame, row_id: str, texts: dict[str, str], keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, *keep, one column for each of texts): tokens of the columns texts[name] of every row, as `name`.

    A null text has null tokens, an empty one 0. Texts are read whole. The rank file (fixed, some 50,000 merges) is read
    by the driver and sent along; nothing is shuffled. Other columns are passed over, whatever their names.
    """
    table = MergeTable(vocabulary)
    keep = keep or []
    names = list(texts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(table)
        for pdf in batches:
            out = {f"k{i}": pdf[f"k{i}"] for i in range(len(keep) + 1)}
            for i in range(len(names)):
                # cut a batch of long texts into blocks of bounded size
                column, done = pdf[f"t{i}"], []
                block: list[str | None] = []
                size = 0
                for t in column:
                    block.append(t)
                    size += len(t) if t else 0
                    if size > 4_000_000:
                        done += counter.count(block)
                        block, size = [], 0
                done += counter.count(block)
                out[f"n{i}"] = pd.array(done, dtype="Int64")
            yield pd.DataFrame(out)

    kept = [row_id, *keep]
    plain = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(texts[n]).cast("string").alias(f"t{i}") for i, n in enumerate(names)])
    types = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join([f"k{i} {types[f'k{i}']}" for i in range(len(kept))] + [f"n{i} bigint" for i in range(len(names))])
    return plain.mapInPandas(count, schema).toDF(*kept, *names)


def token_totals(counts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Totals of token columns for every combination of `by` (nulls are a slice of their own): rows, and the sum of each column."""
    return counts.groupBy(*by).agg(F.count("*").alias("records"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
