"""Problem 2: new batches checked against all history, without going through the history for each.

Every commit (a batch, or several that wait) becomes an immutable segment: the suffix array of its concatenated words. A
suffix is one 64-bit number, 48 bits for its first k words and 16 for the next, so a sorted array of numbers is the sorted
array of suffixes; it is cut into parts by leading bits, as many as its size asks for, and written by part. A search
sends some suffixes of each batch text (its rarest, as many as a near text can't all miss) to the parts they belong to, reads those
parts alone, finds every match by binary search, adds up by record how much of the text it covers, and verifies what is covered enough.
Where more than a few texts are searched, the arrays stay where they are: each task reads the parts that its suffixes hit, which are the
rarest by their counts in the store; and matches are made in rounds, none of more matches than the store has entries.
Segments of like size are merged, so their number grows with the logarithm of the history. A manifest in the store's
folder names what holds; it is written last, and segments it no longer names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone import scratch
from loomstone.llm import common
from loomstone.llm.shingles import Encoded, Order, Shape, near, prefixes, rare_first, read_order, write_order

ENTRIES_A_PART = 2_000_000
RUN_ENTRIES = 1_000_000
EMIT_ENTRIES = 2_000_000
MOST_BITS = 20
PAIRS_AT_ONCE = 2_000_000
FIRST_MATCHES = 1_000
BROADCAST_ENTRIES = 2_000_000
HITS_AT_ONCE = 10_000_000
SPREAD_ENTRIES = 50_000
BROADCAST_PAIRS = 1_000_000
NAMED_PARTS = 10_000
COMMIT_SHARE = 16
SLOT_BITS = 17
PARTITION_BITS = 33  # monotonically_increasing_id numbers the rows of a partition in so many bits
WHOLE = 255
NEXT = np.uint64(16)
ROWS = "seg int, part int, n int, suffix binary, tid binary, tag binary"
HITS = "probe bigint, tid bigint, least int"
COUNTS = "probe bigint, place int, suffix bigint, width bigint"
NO_RECORD = -1

# Sizes of texts are kept in a byte: steps of a twentieth, of which only the lower and the upper end are used.
SIZE_STEPS = np.ceil(1.05 ** np.arange(WHOLE)).astype(np.int64)


@dataclass
class Segment:
    """One immutable segment: its folder, into how many parts (2^bits) its array is cut, how many texts and words it holds."""

    name: str
    bits: int
    texts: int
    words: int


@dataclass
class Manifest:
    version: int = 0
    next_tid: int = 0
    order: str | None = None
    order_texts: int = 0
    commits: list[str] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)


# --- arrays ------------------------------------------------------------------------------------------------------------
def _pack(a: np.ndarray) -> bytes:
    """64-bit numbers as two planes of halves: the higher halves of sorted or small numbers compress well."""
    halves = np.ascontiguousarray(a).view(np.uint32).reshape(-1, 2)
    return halves[:, 1].tobytes() + halves[:, 0].tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint32).reshape(2, -1)
    out = np.empty((planes.shape[1], 2), np.uint32)
    out[:, 1], out[:, 0] = planes[0], planes[1]
    return out.reshape(-1).view(kind)


def _cut(suffix: np.ndarray, tid: np.ndarray, tag: np.ndarray, targets: list[tuple[int, int]]) -> pd.DataFrame:
    """Rows of sorted arrays, one for each part (or for each million entries of it), for every (segment, bits) of targets."""
    o = np.lexsort((tid, suffix))
    suffix, tid, tag = suffix[o], tid[o], tag[o]
    rows = []
    for seg, bits in targets:
        part = (suffix >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(suffix), np.int64)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            for at in range(a, b, RUN_ENTRIES):
                to = min(at + RUN_ENTRIES, b)
                rows.append((seg, part[a], to - at, _pack(suffix[at:to]), _pack(tid[at:to]), tag[at:to].tobytes()))
    return pd.DataFrame(rows, columns=["seg", "part", "n", "suffix", "tid", "tag"]).astype({"seg": "int32", "part": "int32", "n": "int32"})


def _suffix_numbers(e: Encoded, gram: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """48 bits of the hash of a suffix's first k words, then 16 of its next word, 0 where the text ends."""
    if not len(at):
        return np.zeros(0, np.uint64)
    follows = at + k
    word = np.where(follows < e.end[at], e.word[np.minimum(follows, len(e.word) - 1)] & np.uint64(0xFFFF) | np.uint64(1), np.uint64(0))
    return (gram >> NEXT) << NEXT | word


def _whole(texts: list[str]) -> np.ndarray:
    """The suffix that is a whole text: how texts of any length meet their copies."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t, 1) for t in texts), np.uint64, len(texts))


def _distinct_suffixes(texts: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every suffix of every text, those that begin alike within a text once: whose it is, its number, and how many each text has."""
    e = Encoded(texts, shape.k)
    o = np.lexsort((e.at, e.gram, e.owner))
    owner, gram, at = e.owner[o], e.gram[o], e.at[o]
    new = np.ones(len(o), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, gram, at = owner[new], gram[new], at[new]
    return owner, _suffix_numbers(e, gram, at, shape.k), np.bincount(owner, minlength=len(texts))


def _all_suffixes(texts: list[str], tid: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every suffix of every text and the whole texts, tagged with the text's size."""
    owner, suffix, sizes = _distinct_suffixes(texts, shape)
    code = np.searchsorted(SIZE_STEPS, np.maximum(sizes, 1), "right") - 1
    return (
        np.r_[suffix, _whole(texts)],
        np.r_[tid[owner], tid],
        np.r_[code[owner], np.full(len(texts), WHOLE)].astype(np.uint8),
    )


def _placed_suffixes(texts: list[str], tid: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every suffix of every text, tagged with its place among them, and the whole texts (place -1)."""
    owner, suffix, sizes = _distinct_suffixes(texts, shape)
    place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    return np.r_[suffix, _whole(texts)], np.r_[tid[owner], tid], np.r_[place, np.full(len(texts), -1)].astype(np.int32)


def _some_suffixes(texts: list[str], tid: np.ndarray, shape: Shape, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest suffixes of every text, of which a near text holds at least `hits`, and the whole texts (size 0)."""
    p = prefixes(texts, shape, order)
    return (
        np.r_[_suffix_numbers(p.encoded, p.gram, p.at, shape.k), _whole(texts)],
        np.r_[tid[p.owner], tid],
        np.r_[p.size, np.zeros(len(texts), np.int64)].astype(np.int32),
    )


def _emit(suffixes: Callable, targets: list[tuple[int, int]]) -> Callable:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(suffixes(pdf["words"].tolist(), pdf["tid"].to_numpy()))
            n += len(held[-1][0])
            if n >= EMIT_ENTRIES:
                yield _cut(*map(np.concatenate, zip(*held, strict=True)), targets)
                held, n = [], 0
        if held:
            yield _cut(*map(np.concatenate, zip(*held, strict=True)), targets)

    return emit


def _merge(tag: type) -> Callable:
    """Sorted arrays of one part, as they come in order of parts, become one (or one for each million entries)."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, n = None, [], 0

        def done() -> pd.DataFrame:
            suffix, tid, tags = (np.concatenate(x) for x in zip(*held, strict=True))
            return _cut(suffix, tid, tags, [(key[0], 0)]).assign(part=np.int32(key[1]))

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if held and ((r.seg, r.part) != key or n >= RUN_ENTRIES):
                    yield done()
                    held, n = [], 0
                key = (r.seg, r.part)
                held.append((_unpack(r.suffix, np.uint64), _unpack(r.tid, np.int64), np.frombuffer(r.tag, tag)))
                n += r.n
        if held:
            yield done()

    return merge


def _gathered(rows: DataFrame, tag: type) -> DataFrame:
    """Arrays brought together by part. Rebalancing splits the arrays of a part that is far larger than others over several tasks,
    whose arrays then stay side by side, so a suffix that a third of all texts hold is in no single task."""
    return rows.hint("rebalance", "seg", "part").sortWithinPartitions("seg", "part").mapInPandas(_merge(tag), ROWS)


def _spread(rows: DataFrame) -> DataFrame:
    """Arrays of probes brought together by part, but those of many entries apart, so a part that very many probes hit is searched by several tasks."""
    apart = F.when(F.col("n") > SPREAD_ENTRIES, F.monotonically_increasing_id()).otherwise(0)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "seg", "part", apart).sortWithinPartitions("seg", "part")


def _part_arrays(folder: str, part: int, columns: list[str]) -> Iterator[list]:
    """The arrays of a part, read by a worker from the shared folder one at a time; none where the segment has no such part."""
    store, inner = scratch.arrow_store(f"{folder}/part={part}")
    for f in store.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as raw:
                for batch in pyarrow.parquet.ParquetFile(raw).iter_batches(1, columns=columns):
                    yield [batch.column(c)[0].as_buffer() for c in columns]


def _range(p_suffix: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest suffix that begins as a probe's does; a whole text matches itself alone."""
    first = np.where(whole, p_suffix, (p_suffix >> NEXT) << NEXT)
    return first, np.where(whole, p_suffix, first | np.uint64(0xFFFF))


def _count(folders: list[str]) -> Callable:
    """How many entries every suffix of the probes matches, by segment; the first segment gives a row for those without any, too."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _merge(np.int32)(batches):
            for r in pdf.itertuples(index=False):
                p_suffix, p_tid, place = _unpack(r.suffix, np.uint64), _unpack(r.tid, np.int64), np.frombuffer(r.tag, np.int32)
                first, last = _range(p_suffix, place < 0)
                width = np.zeros(len(p_suffix), np.int64)
                for (raw,) in _part_arrays(folders[r.seg], r.part, ["suffix"]):
                    suffix = _unpack(raw, np.uint64)
                    width += np.searchsorted(suffix, last, "right") - np.searchsorted(suffix, first, "left")
                out = pd.DataFrame({"probe": p_tid, "place": place, "suffix": p_suffix.view(np.int64), "width": width})
                yield out if r.seg == 0 else out[width > 0]

    return count


def _rarest(counts: DataFrame, shape: Shape) -> DataFrame:
    """(probe, suffix, size, width): of every probe's suffixes the rarest, as many as prefixes() gives, and the whole texts (size 0).
    The probes are in the store, so what is matched once is matched by itself alone and is left out."""
    top, low = shape.ratio.numerator, shape.ratio.denominator
    whole = (F.col("place") < 0).alias("whole")
    every = counts.repartition("probe").groupBy("probe", "place", "suffix", whole).agg(F.sum("width").alias("width"))
    own = Window.partitionBy("probe", "whole")
    ranked = every.withColumn("turn", F.row_number().over(own.orderBy("width", "place"))).withColumn("m", F.count("*").over(own))
    looked = F.col("m") - F.floor((F.col("m") * top + (low - 1)) / low) + shape.hits
    return ranked.where((F.col("whole") | (F.col("turn") <= looked)) & (F.col("width") > 1)).select("probe", "suffix", F.when(F.col("whole"), 0).otherwise(F.col("m")).cast("int").alias("size"), "width")


def _cut_rows(targets: list[tuple[int, int]]) -> Callable:
    """Arrays by part of suffixes that come as rows."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= EMIT_ENTRIES:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    def cut(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        return _cut(rows["suffix"].to_numpy(np.int64).view(np.uint64), rows["probe"].to_numpy(np.int64), rows["size"].to_numpy(np.int32), targets)

    return emit


def _matches(shape: Shape, most: int | None, suffix: np.ndarray, tid: np.ndarray, code: np.ndarray, p_suffix: np.ndarray, p_tid: np.ndarray, p_size: np.ndarray) -> Iterator[pd.DataFrame]:
    top, low = shape.ratio.numerator, shape.ratio.denominator
    first, last = _range(p_suffix, p_size == 0)
    left, right = np.searchsorted(suffix, first, "left"), np.searchsorted(suffix, last, "right")
    if most is not None:
        wide = np.flatnonzero(right - left > most)
        if len(wide):  # then the longer matches, which are in order of arrival, the earliest of them
            left[wide] = np.searchsorted(suffix, p_suffix[wide], "left")
            right[wide] = np.minimum(np.searchsorted(suffix, p_suffix[wide], "right"), left[wide] + most)
            cut = np.unique(p_tid[wide])
            yield pd.DataFrame({"probe": cut, "tid": np.full(len(cut), NO_RECORD), "least": np.zeros(len(cut), np.int32)})
    width = right - left
    ends, at = np.cumsum(width), 0
    while at < len(width):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        w = width[at:to]
        probe = np.repeat(np.arange(at, to), w)
        entry = np.arange(len(probe)) - np.repeat(np.cumsum(w) - w, w) + left[probe]
        m, c = p_size[probe], code[entry]
        is_whole = m == 0
        n_low, n_high = SIZE_STEPS[np.minimum(c, WHOLE - 1)], np.r_[SIZE_STEPS[1:] - 1, 1 << 40, 1 << 40][c]
        fits = (n_low * top <= m * low) & (n_high * low >= m * top)
        good = (tid[entry] < p_tid[probe]) & (is_whole == (c == WHOLE)) & (is_whole | fits)
        probe, entry, m, n_low, is_whole = probe[good], entry[good], m[good], n_low[good], is_whole[good]
        looked = np.minimum(m, shape.prefix(m))
        least = np.where(is_whole, 0, np.maximum(1, shape.needed(m, np.maximum(n_low, -(-m * top // low))) - (m - looked)))
        yield pd.DataFrame({"probe": p_tid[probe], "tid": tid[entry], "least": least.astype(np.int32)})
        at = to


def _probe(suffix: bytes, tid: bytes, tag: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpack(suffix, np.uint64), _unpack(tid, np.int64), np.frombuffer(tag, np.int32).astype(np.int64)


def _search(shape: Shape, most: int | None) -> Callable:
    """Arrays and probes that were joined by part."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield from _matches(shape, most, _unpack(r.suffix, np.uint64), _unpack(r.tid, np.int64), np.frombuffer(r.tag, np.uint8), *_probe(r.p_suffix, r.p_tid, r.p_tag))

    return search


def _search_parts(shape: Shape, most: int | None, folders: list[str]) -> Callable:
    """Probes alone: the arrays of their parts are read where they lie."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _merge(np.int32)(batches):
            for r in pdf.itertuples(index=False):
                probe = _probe(r.suffix, r.tid, r.tag)
                for suffix, tid, tag in _part_arrays(folders[r.seg], r.part, ["suffix", "tid", "tag"]):
                    yield from _matches(shape, most, _unpack(suffix, np.uint64), _unpack(tid, np.int64), np.frombuffer(tag, np.uint8), *probe)

    return search


def _word_count(words: str) -> Column:
    """No less than the entries of a text: its words, and two."""
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 2


# --- the store -----------------------------------------------------------------------------------------------------------
class SegmentStore:
    """Suffix arrays and texts of all that was accepted, in a folder that all executors share.

    ingest() checks the rows of new batches against all that came before them and adds them. Rows are in order of (batch, id),
    a null batch last; texts are kept whole, one for each distinct text of a commit, numbered in order of arrival, so
    "earlier" is a smaller number. A store opened again on the same folder goes on where the last finished ingest ended;
    what an interrupted one left is not named in the manifest and counts for nothing.
    """

    def __init__(self, spark: SparkSession, path: str, shape: Shape | None = None, entries_a_part: int = ENTRIES_A_PART) -> None:
        self.spark, self.path, self.shape, self.entries_a_part = spark, path.rstrip("/"), shape or Shape(), entries_a_part
        self.manifest = self._read_manifest()
        self.order = read_order(spark, f"{self.path}/{self.manifest.order}") if self.manifest.order else None
        self._passing: list[str] = []

    # manifest
    def _read_manifest(self) -> Manifest:
        versions = [int(n.split("-")[1]) for n in scratch.names(self.spark, self.path) if n.startswith("manifest-")]
        if not versions:
            return Manifest()
        held = json.loads(scratch.read_text(self.spark, f"{self.path}/manifest-{max(versions)}"))
        return Manifest(**held | {"segments": [Segment(**s) for s in held["segments"]]})

    def _commit(self, new: Manifest) -> None:
        """Names what holds from now on, then removes what held before only."""
        new.version = self.manifest.version + 1
        scratch.write_text(self.spark, f"{self.path}/manifest-{new.version}", json.dumps(asdict(new)))
        gone = {s.name for s in self.manifest.segments} - {s.name for s in new.segments}
        gone |= {self.manifest.order} - {new.order, None}
        if self.manifest.version:
            gone.add(f"manifest-{self.manifest.version}")
        for name in gone:
            scratch.remove(self.spark, f"{self.path}/{name}")
        self.manifest = new

    def _new_name(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _bits(self, words: int) -> int:
        return min(MOST_BITS, max(0, int(np.ceil(np.log2(max(1, words) / self.entries_a_part)))))

    # segments
    def _texts_of(self, name: str, slots: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema("tid bigint, id bigint, words string, slot bigint").parquet(f"{self.path}/{name}/texts")
        return df if slots is None else df.where(F.col("slot").isin(slots))

    def _arrays_of(self, name: str, parts: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema("n int, suffix binary, tid binary, tag binary, part int").parquet(f"{self.path}/{name}/arrays")
        return df if parts is None else df.where(F.col("part").isin(parts))

    def _write_arrays(self, rows: DataFrame, name: str) -> None:
        _gathered(rows, np.uint8).drop("seg").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{name}/arrays")

    def _write_segment(self, texts: DataFrame, name: str) -> Segment:
        """Texts get their numbers as they are written; then the array is built from what was written."""
        numbered = texts.withColumn("tid", F.lit(self.manifest.next_tid) + F.monotonically_increasing_id())
        numbered.withColumn("slot", F.shiftright("tid", SLOT_BITS)).write.partitionBy("slot").parquet(f"{self.path}/{name}/texts")
        held = self._texts_of(name)
        size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(_word_count("words")), F.lit(0)).alias("w"), F.max("tid").alias("last")).first()
        self._last = self.manifest.next_tid if size.last is None else ((size.last >> PARTITION_BITS) + 1) << PARTITION_BITS
        segment, shape = Segment(name, self._bits(size.w), size.n, size.w), self.shape
        self._write_arrays(held.select("tid", "words").mapInPandas(_emit(lambda t, i: _all_suffixes(t, i, shape), [(0, segment.bits)]), ROWS), name)
        return segment

    def _merged(self, a: Segment, b: Segment) -> Segment:
        """One segment of two: sorted arrays are cut anew where the parts are smaller now, and merged part by part."""
        name = self._new_name("segment")
        new = Segment(name, self._bits(a.words + b.words), a.texts + b.texts, a.words + b.words)

        def recut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    yield _cut(_unpack(r.suffix, np.uint64), _unpack(r.tid, np.int64), np.frombuffer(r.tag, np.uint8), [(0, new.bits)])

        arrays = None
        for s in (a, b):
            one = self._arrays_of(s.name).select(F.lit(0).alias("seg"), "part", "n", "suffix", "tid", "tag")
            one = one if s.bits == new.bits else one.mapInPandas(recut, ROWS)
            arrays = one if arrays is None else arrays.unionByName(one)
        self._write_arrays(arrays, name)
        self._texts_of(a.name).unionByName(self._texts_of(b.name)).write.partitionBy("slot").parquet(f"{self.path}/{name}/texts")
        return new

    # search
    def _candidates(self, probes: DataFrame, segments: list[Segment], most: int | None) -> DataFrame:
        """(probe, tid): earlier texts covered enough, written; tid -1 for a probe of which not every match was followed."""
        shape, order = self.shape, self.order
        targets = [(i, s.bits) for i, s in enumerate(segments)]
        # what the probes can match at most; small batches are sent to where the arrays lie
        words = len(segments) * (probes.agg(F.sum(_word_count("words"))).first()[0] or 0)
        room = max(HITS_AT_ONCE, sum(s.words for s in segments))
        if words > BROADCAST_ENTRIES or words * (most or sum(s.texts for s in segments)) > room:
            return self._in_rounds(probes, segments, targets, most, room)
        arrays = probes.select("tid", "words").mapInPandas(_emit(lambda t, i: _some_suffixes(t, i, shape, order), targets), ROWS)
        arrays = self._written(_gathered(arrays, np.int32), "probes")
        sizes = arrays.groupBy("seg", "part").agg(F.sum("n").alias("n")).limit(NAMED_PARTS + 1).collect()
        if len(sizes) > NAMED_PARTS:
            return self._in_rounds(probes, segments, targets, most, room)
        held = None
        for i, s in enumerate(segments):
            one = self._arrays_of(s.name, [r.part for r in sizes if r.seg == i]).select(F.lit(i).alias("seg"), "part", "suffix", "tid", "tag")
            held = one if held is None else held.unionByName(one)
        asked = arrays.select("seg", "part", F.col("suffix").alias("p_suffix"), F.col("tid").alias("p_tid"), F.col("tag").alias("p_tag"))
        return self._covered(held.join(F.broadcast(asked), ["seg", "part"]).mapInPandas(_search(shape, most), HITS))

    def _in_rounds(self, probes: DataFrame, segments: list[Segment], targets: list[tuple[int, int]], most: int | None, room: int) -> DataFrame:
        """The candidates of many probes. All their suffixes are counted first, so the rarest are known and how much they match; then some
        probes are searched at a time, so the matches that are shuffled are never many more than `room`."""
        shape, folders = self.shape, [scratch.qualified(self.spark, f"{self.path}/{s.name}/arrays") for s in segments]
        placed = probes.select("tid", "words").mapInPandas(_emit(lambda t, i: _placed_suffixes(t, i, shape), targets), ROWS)
        rarest = self._written(_rarest(_spread(placed).mapInPandas(_count(folders), COUNTS), shape), "rarest")
        # of a suffix with very many matches, `most` are followed in each array
        followed = F.col("width") if most is None else F.least(F.col("width"), most * (2 * len(segments) + F.floor(F.col("width") / RUN_ENTRIES)))
        total = rarest.agg(F.sum(followed.cast("double"))).first()[0] or 0
        rounds = max(1, int(np.ceil(total / room)))
        paths = []
        for i in range(rounds):
            some = rarest.where(F.pmod(F.xxhash64("probe"), F.lit(rounds)) == i)
            asked = _spread(some.select("probe", "suffix", "size").mapInPandas(_cut_rows(targets), ROWS))
            self._covered(asked.mapInPandas(_search_parts(shape, most, folders), HITS))
            paths.append(self._passing[-1])
        return self.spark.read.schema("probe bigint, tid bigint").parquet(*paths)

    def _covered(self, hits: DataFrame) -> DataFrame:
        covered = hits.groupBy("probe", "tid").agg(F.count("*").alias("shared"), F.min("least").alias("least")).where("shared >= least")
        return self._written(covered.select("probe", "tid"), "covered")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """A table between steps of an ingest, removed when that ends."""
        path = scratch.scratch_path(self.spark, name)
        self._passing.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _verified(self, candidates: DataFrame, probes: DataFrame, segments: list[Segment]) -> tuple[DataFrame, bool]:
        """(tid) of the probes that are the same as, or near, one of their candidates, by their words alone; and whether for some
        probe not every match was followed."""
        placed = candidates.withColumn("slot", F.when(F.col("tid") != NO_RECORD, F.shiftright("tid", SLOT_BITS)))
        slots = placed.groupBy("slot").agg(F.count("*").alias("n")).limit(NAMED_PARTS + 2).collect()
        few = len(slots) <= NAMED_PARTS
        held = None
        for s in segments:
            one = self._texts_of(s.name, [r.slot for r in slots if r.slot is not None] if few else None).select("slot", "tid", F.col("words").alias("words_h"))
            held = one if held is None else held.unionByName(one)
        real = placed.where("slot is not null")
        small = few and sum(r.n for r in slots) <= BROADCAST_PAIRS
        pairs = held.join(F.broadcast(real) if small else real, ["slot", "tid"])
        asked = probes.select(F.col("tid").alias("probe"), F.col("words").alias("words_p"))
        pairs = pairs.join(asked, "probe")
        same = (F.col("words_p") == F.col("words_h")) | near(self.shape)("words_p", "words_h")
        return pairs.where(same).select(F.col("probe").alias("tid")).distinct(), not few or any(r.slot is None for r in slots)

    def _near_earlier(self, probes: DataFrame, segments: list[Segment]) -> DataFrame:
        """(tid) of the probes for which there is an earlier text. One is enough: where a suffix has very many matches, the first of the longer ones settle
        most probes, and only those that they don't settle are searched to the end."""
        first = self._candidates(probes, segments, FIRST_MATCHES)
        found, some_cut = self._verified(first, probes, segments)
        if not some_cut:
            return found
        found = self._written(found, "near-first")
        cut = first.where(F.col("tid") == NO_RECORD).select(F.col("probe").alias("tid"))
        rest = self._written(probes.join(cut, "tid", "left_semi").join(found, "tid", "left_anti"), "unsettled")
        if rest.isEmpty():
            return found
        return found.unionByName(self._verified(self._candidates(rest, segments, None), rest, segments)[0])

    def ingest(self, df: DataFrame, record_id: str, text: str, batch: str | None = None, check: bool = True) -> DataFrame:
        """(id): the rows of df whose text is the same as, or near, one in the store or of an earlier row of df. Then df is in the store.

        Null ids and texts are left out; a repeated row (same id, same text) is one row; an empty df gives no row and changes nothing.
        Without check nothing is looked for, as for the first history, and of df only its texts are kept. What is shuffled and written on the
        way is removed step by step, so the disk holds the store and one step's files.
        """
        try:
            with scratch.shuffles_removed(self.spark):
                return self._ingest(df, record_id, text, batch, check)
        finally:
            while self._passing:
                scratch.remove(self.spark, self._passing.pop())

    def _ingest(self, df: DataFrame, record_id: str, text: str, batch: str | None, check: bool) -> DataFrame:
        came = F.coalesce(F.col(batch).cast("bigint"), F.lit((1 << 62) - 1)) if batch else F.lit(0).cast("bigint")
        rows = df.select(F.col(record_id).cast("bigint").alias("id"), came.alias("batch"), common.word_text(F.col(text).cast("string")).alias("words")).where("id is not null and words is not null")
        if check:
            by_batch = rows.groupBy("words", "batch").agg(F.min("id").alias("id"))
            firsts = by_batch.groupBy("words").agg(F.min(F.struct("batch", "id")).alias("key"))
            texts = firsts.orderBy("key").select(F.col("key.id").alias("id"), "words")
        else:
            texts = rows.groupBy("words").agg(F.min("id").alias("id")).select("id", "words")
        name = self._new_name("segment")
        own = self._write_segment(texts, name)
        if own.texts == 0:
            scratch.remove(self.spark, f"{self.path}/{name}")
            return self.spark.createDataFrame([], "id bigint")
        new = Manifest(0, self._last, self.manifest.order, self.manifest.order_texts, list(self.manifest.commits), [*self.manifest.segments, own])
        held = self._texts_of(name)
        if self.order is None or own.texts > new.order_texts:
            self.order, new.order, new.order_texts = rare_first(held, "words", self.shape.k), self._new_name("order"), own.texts
            write_order(self.spark, self.order, f"{self.path}/{new.order}")
        if check:
            earlier = self._near_earlier(held.select("tid", "words"), new.segments)
            named = held.select("tid", "id").join(earlier, "tid").select("id")
            k1, k2, n = common.text_key(F.col("words"))
            first_rows = held.select("id", k1.alias("k1"), k2.alias("k2"), n.alias("n"))
            copies = rows.select("id", k1.alias("k1"), k2.alias("k2"), n.alias("n")).join(first_rows, ["id", "k1", "k2", "n"], "left_anti").select("id")
            seen = self._new_name("seen")
            named.unionByName(copies).distinct().write.parquet(f"{self.path}/{seen}")
            new.commits.append(seen)
        while len(new.segments) > 1 and 2 * new.segments[-1].texts > new.segments[-2].texts:
            b, a = new.segments.pop(), new.segments.pop()
            merged = self._merged(a, b)
            for s in (a, b):
                if s not in self.manifest.segments:
                    scratch.remove(self.spark, f"{self.path}/{s.name}")
            new.segments.append(merged)
        self._commit(new)
        return self.spark.read.schema("id bigint").parquet(f"{self.path}/{seen}") if check else self.spark.createDataFrame([], "id bigint")

    def catch_up(self, df: DataFrame, record_id: str, text: str, batch: str) -> None:
        """Ingests all batches of df in their order. Batches that wait are committed together while they come to no more than a
        sixteenth of the texts there, so however small they are, going through a backlog reads the arrays some sixteen times in
        all for each doubling of the store. A lone batch is a commit of its own. What comes to the driver is one row for each batch."""
        key = F.col(batch).cast("bigint")
        sizes = df.where(F.col(record_id).isNotNull() & F.col(text).isNotNull()).groupBy(key.alias("b")).agg(F.count("*").alias("n")).collect()
        waiting = sorted(sizes, key=lambda r: (r.b is None, r.b))
        while waiting:
            room = sum(s.texts for s in self.manifest.segments) // COMMIT_SHARE
            take = 1
            while take < len(waiting) and sum(r.n for r in waiting[: take + 1]) <= room:
                take += 1
            now, waiting = waiting[:take], waiting[take:]
            inside = F.lit(False) if now[0].b is None else key.between(now[0].b, max(r.b for r in now if r.b is not None))
            if now[-1].b is None:
                inside = inside | key.isNull()
            self.ingest(df.where(inside), record_id, text, batch)

    def seen(self) -> DataFrame:
        """(id): all rows of all ingests that were there before."""
        paths = [f"{self.path}/{c}" for c in self.manifest.commits]
        return self.spark.read.schema("id bigint").parquet(*paths).distinct() if paths else self.spark.createDataFrame([], "id bigint")


def seen_before(history: DataFrame, history_id: str, history_text: str, new: DataFrame, new_id: str, batch: str, new_text: str, shape: Shape | None = None) -> DataFrame:
    """(new_id): rows of `new` whose text is the same as, or near, one of the history or of an earlier new row.

    Earlier means smaller batch, then smaller id; a null batch comes last. Same: equal sequences of words. Near: by
    shape. Null texts match nothing; rows with a null id are left out; a repeated row (same id) is one row. The history is ingested
    into a store in the shared folder, and the batches after it (see SegmentStore.catch_up).
    """
    spark = new.sparkSession
    store = SegmentStore(spark, scratch.scratch_path(spark, "store"), shape or Shape())
    store.ingest(history, history_id, history_text, check=False)
    store.catch_up(new, new_id, new_text, batch)
    return store.seen().select(F.col("id").alias(new_id))
