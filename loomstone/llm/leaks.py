"""Problem 8: evaluation texts leaking into training text, by Wu-Manber search over words.

The patterns are all runs of 12 words of the evaluation items. A block of two words that no pattern holds lets the
search skip eleven words; a block that ends patterns selects them by its hash bucket, and their words are compared with
the text one by one. Texts and items are read in the one form of problem 10; a word is its 64-bit hash. The tables are built by executors
and written in the shared folder, in blocks of bounded size; documents are read and brought to their form once, and each batch of
them is searched with one block after another, so no item passes the driver, and documents aren't read again for more items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import common
from loomstone.llm.lookalike import Rewriter
from loomstone.scratch import scratch_path

WORD = re.compile(r"[^\W_]+")
RUN_WORDS = 12
PIECE_WORDS = 4096
PATTERNS_AT_ONCE = 200_000
BATCH_WORDS = 4_000_000
TABLES = "block int, last binary, runs binary, owners binary, blocks binary, shifts binary"


def form_words(text: str, rewriter: Rewriter) -> list[str]:
    """Words of a text in the one form."""
    return " ".join(WORD.findall(rewriter(text))).lower().split(" ") if text else []


def word_hashes(texts: list[list[str]]) -> np.ndarray:
    """The words of all texts as one array of hashes, each distinct word hashed once."""
    flat = list(chain.from_iterable(texts))
    codes: dict[str, int] = {}
    index = np.fromiter((codes.setdefault(w, len(codes)) for w in flat), np.int64, len(flat))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes))[index] if flat else np.zeros(0, np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two words that follow each other."""
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))


class WuManber:
    """Searches texts, as arrays of word hashes, for runs of `length` words.

    runs are in order of the block of their last two words (last); blocks are all blocks of two words in any run, with how far the
    search may go on from there (shifts).
    """

    def __init__(self, length: int, last: np.ndarray, runs: np.ndarray, owners: np.ndarray, blocks: np.ndarray, shifts: np.ndarray) -> None:
        self.length, self.last, self.runs, self.owners, self.blocks, self.shifts = length, last, runs, owners, blocks, shifts

    @classmethod
    def build(cls, runs: np.ndarray, owners: np.ndarray, length: int = RUN_WORDS) -> WuManber:
        last = _pair(runs[:, -2], runs[:, -1])
        order = np.argsort(last, kind="stable")
        blocks = np.concatenate([_pair(runs[:, j], runs[:, j + 1]) for j in range(length - 1)])
        shifts = np.repeat(length - 2 - np.arange(length - 1), len(runs))
        o = np.lexsort((shifts, blocks))
        first = np.r_[True, blocks[o][1:] != blocks[o][:-1]] if len(blocks) else np.zeros(0, bool)
        return cls(length, last[order], runs[order], owners[order], blocks[o][first], shifts[o][first].astype(np.int64))

    def tables(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n)).tobytes() for n in ("last", "runs", "owners", "blocks", "shifts")}

    @classmethod
    def read(cls, row: dict, length: int) -> WuManber:
        numbers = lambda n, kind=np.uint64: np.frombuffer(row[n], kind)
        return cls(length, numbers("last"), numbers("runs").reshape(-1, length), numbers("owners", np.int64), numbers("blocks"), numbers("shifts", np.int64))

    def search(self, words: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, item) pairs for pieces words[starts[i]:ends[i]]; all pieces move on together."""
        if not len(self.runs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        piece = np.flatnonzero(ends - starts >= self.length)
        at = starts[piece] + self.length - 1
        pieces, items = [], []
        while len(piece):
            block = _pair(words[at - 1], words[at])
            slot = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
            shift = np.where(self.blocks[slot] == block, self.shifts[slot], self.length - 1)
            here = np.flatnonzero(shift == 0)
            if len(here):
                left = np.searchsorted(self.last, block[here], "left")
                width = np.searchsorted(self.last, block[here], "right") - left
                which = np.repeat(here, width)
                run = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(left, width)
                same = np.ones(len(which), bool)
                for j in range(self.length):
                    same &= self.runs[run, j] == words[at[which] - self.length + 1 + j]
                pieces.append(piece[which[same]])
                items.append(self.owners[run[same]])
            at = at + np.maximum(shift, 1)
            more = at < ends[piece]
            piece, at = piece[more], at[more]
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(pieces), np.concatenate(items)

    def search_texts(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows (text index, item), each once, for texts of these lengths. Long texts are cut into pieces that overlap by a run less one word."""
        begin = np.cumsum(lengths) - lengths
        step = PIECE_WORDS - self.length + 1
        n = np.maximum(1, -(-(lengths - self.length + 1) // step))
        owner = np.repeat(np.arange(len(lengths)), n)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = begin[owner] + turn * step
        ends = np.minimum(starts + PIECE_WORDS, (begin + lengths)[owner])
        piece, item = self.search(words, ends, starts)
        return np.unique(np.stack([owner[piece], item], 1), axis=0) if len(piece) else np.zeros((0, 2), np.int64)


def write_tables(items: DataFrame, item_id: str, text: str, length: int = RUN_WORDS) -> tuple[str, int]:
    """(path, blocks): the search tables of all items, in blocks of some 200,000 runs, a folder each. Runs of one item may lie in several."""
    plain = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter()
        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                h = word_hashes([form_words(t, rewriter)])
                if len(h) >= length:
                    every = np.unique(np.lib.stride_tricks.sliding_window_view(h, length), axis=0)
                    for at in range(0, len(every), BATCH_WORDS // length):
                        some = every[at : at + BATCH_WORDS // length]
                        yield pd.DataFrame({"item": np.full(len(some), i, np.int64), "run": [r.tobytes() for r in some]})

    found = common.materialise(plain.mapInPandas(runs, "item bigint, run binary"), "runs").distinct()
    blocks = max(1, -(-found.count() // PATTERNS_AT_ONCE))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        searcher = WuManber.build(np.frombuffer(b"".join(pdf["run"]), np.uint64).reshape(-1, length), pdf["item"].to_numpy(np.int64), length)
        return pd.DataFrame([{"block": pdf["block"].iloc[0]} | searcher.tables()])

    path = scratch_path(items.sparkSession, "search-tables")
    placed = found.withColumn("block", F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int"))
    placed.groupBy("block").applyInPandas(build, TABLES).write.partitionBy("block").parquet(path)
    return path, blocks


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _load(path: str, block: int, length: int) -> list[WuManber]:
    """The tables of a block, read by a worker from the shared folder; none where a block has no run."""
    if path.startswith("file:"):
        store, inner = pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, inner = pyarrow.fs.FileSystem.from_uri(path)
    inner = f"{inner}/block={block}"
    if store.get_file_info(inner).type == pyarrow.fs.FileType.NotFound:
        return []
    return [WuManber.read(r, length) for r in pyarrow.dataset.dataset(inner, format="parquet", filesystem=store).to_table().to_pylist()]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, length: int = RUN_WORDS) -> DataFrame:
    """(doc_id, item_id): documents that hold at least `length` consecutive words of an item, and the item; distinct.

    Null ids and texts are left out on both sides; items of fewer words are in no document. Documents are read whole, and once.
    """
    plain = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    path, blocks = write_tables(items, item_id, item_text, length)
    found = plain.mapInPandas(_scan(_qualified(docs.sparkSession, path), blocks, length), "doc bigint, item bigint")
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def _scan(path: str, blocks: int, length: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter()
        kept = _load(path, 0, length) if blocks == 1 else None
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            held: list[list[str]] = []
            first = 0
            total = 0
            for i, t in enumerate(pdf["text"]):
                held.append(form_words(t, rewriter))
                total += len(held[-1])
                if total >= BATCH_WORDS or i == len(pdf) - 1:
                    words, lengths = word_hashes(held), np.fromiter(map(len, held), np.int64, len(held))
                    for b in range(blocks):
                        for searcher in kept if kept is not None else _load(path, b, length):
                            pairs = searcher.search_texts(words, lengths)
                            yield pd.DataFrame({"doc": ids[first + pairs[:, 0]], "item": pairs[:, 1]})
                    held, first, total = [], i + 1, 0

    return scan
