"""Near questions across batches and splits, against brute force; the store of segments, batch by batch."""

import pathlib
import random
import time

import pytest

from loomstone import scratch
from loomstone.llm import history, overlap
from loomstone.llm.shingles import Shape

NOUNS = "cats dogs maps jars figs oars bells drums".split()


def sentences(rng, n):
    return " ".join(f"{rng.choice('ABCDEFG')}{rng.randint(1, 40)} keeps {rng.randint(1, 60)} {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} shop." for _ in range(n))


def questions(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = str(rng.randint(1, 60))
            out.append("  ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
        else:
            out.append(sentences(rng, rng.randint(1, 4)))
    return out


def words(t):
    return tuple("".join(ch if ch.isalnum() else " " for ch in t).lower().split())


def near(a, b, k, num, den):
    x, y = words(a), words(b)
    if x == y:
        return True
    p, q = set(zip(*(x[j:] for j in range(k)), strict=False)), set(zip(*(y[j:] for j in range(k)), strict=False))
    both = len(p & q)
    return both > 0 and both * den >= num * len(p | q)


@pytest.mark.parametrize(("shape", "num", "den"), [(Shape(3, "0.6"), 6, 10), (Shape(), 8, 10), (Shape(2, "0.5"), 5, 10)])
def test_cross_split(spark, shape, num, den):
    qs = questions(7, 220)
    rows = [(i, q, "test" if i % 3 == 0 else "train") for i, q in enumerate(qs)]
    got = {tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, "i bigint, q string, s string"), "i", "q", "s", shape=shape).collect()}
    want = {(min(a, b), max(a, b)) for a, q, s in rows for b, r, t in rows if s == "test" and t == "train" and near(q, r, shape.k, num, den)}
    assert got == want and want


def test_cross_split_with_hot_shingles(spark, monkeypatch):
    """Shingles and texts held by many are cut and spread; the report counts what the pairs are."""
    from loomstone.llm import shingles

    monkeypatch.setattr(shingles, "HOT_SHINGLE", 7)
    monkeypatch.setattr(overlap, "HOT_TEXT", 5)
    shape = Shape(3, "0.6")
    rng = random.Random(4)
    qs = [f"it is market day again and {rng.choice(NOUNS[:3])} are {rng.choice(NOUNS)}" for _ in range(90)]
    rows = [(i, q, "test" if i % 4 == 0 else "train", f"s{i % 2}") for i, q in enumerate(qs)]
    df = spark.createDataFrame(rows, "i bigint, q string, s string, o string")
    want = {(min(a, b), max(a, b)) for a, q, s, _ in rows for b, r, t, _ in rows if s == "test" and t == "train" and near(q, r, 3, 6, 10)}
    assert {tuple(r) for r in overlap.cross_split_pairs(df, "i", "q", "s", shape=shape).collect()} == want
    report = {(r.split, r.source): (r.records, r.pairs) for r in overlap.overlap_report(df, "i", "q", "s", "o", spark.createDataFrame([(10,)], "test_n int"), shape=shape).collect()}
    ends = [e for p in want for e in p]
    for i, source in ((i, o) for i in ("test", "train") for o in ("s0", "s1")):
        mine = [e for e in ends if rows[e][2] == i and rows[e][3] == source]
        assert report.get((i, source), (0, 0)) == (len(set(mine)), len(mine))


def seen(spark, old, new, shape):
    """new: (id, batch, text)."""
    df = spark.createDataFrame(new, "i bigint, b int, q string")
    olds = spark.createDataFrame([(i, q) for i, q in enumerate(old)], "i bigint, q string")
    return {r[0] for r in history.seen_before(olds, "i", "q", df, "i", "b", "q", shape).collect()}


def brute(old, new, shape):
    num, den = shape.ratio.numerator, shape.ratio.denominator
    return {i for i, b, q in new if any(near(q, o, shape.k, num, den) for o in old) or any((c, j) < (b, i) and near(q, r, shape.k, num, den) for j, c, r in new)}


@pytest.mark.parametrize("shape", [Shape(3, "0.6"), Shape()])
def test_seen_before(spark, shape):
    qs = questions(11, 240)
    old, new = qs[:120], [(1000 - i, i % 2, q) for i, q in enumerate(qs[120:])]
    assert seen(spark, old, new, shape) == brute(old, new, shape) != set()


@pytest.mark.parametrize("most", [1])
def test_first_matches_then_all(spark, monkeypatch, most):
    """With few matches followed at first, the probes they don't settle are searched to the end."""
    monkeypatch.setattr(history, "FIRST_MATCHES", most)
    qs = questions(17, 160)
    old, new = qs[:80], [(i, 0, q) for i, q in enumerate(qs[80:])]
    assert seen(spark, old, new, Shape(3, "0.6")) == brute(old, new, Shape(3, "0.6"))


def test_hot_suffixes(spark, monkeypatch):
    """Every text shares a frequent opening; arrays of a part lie side by side, probes and arrays meet by a shuffle, and no pair is lost."""
    monkeypatch.setattr(history, "RUN_ENTRIES", 50)
    monkeypatch.setattr(history, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(history, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(history, "NAMED_PARTS", 0)
    monkeypatch.setattr(history, "PAIRS_AT_ONCE", 100)
    rng = random.Random(3)
    qs = [f"it is market day again and {rng.choice(NOUNS)} are {rng.choice(NOUNS)}" for _ in range(150)]
    old, new = qs[:75], [(i, 0, q) for i, q in enumerate(qs[75:])]
    assert seen(spark, old, new, Shape(3, "0.6")) == brute(old, new, Shape(3, "0.6"))


def test_store_batch_by_batch(spark, tmp_path):
    """Batches of one size: their segments are merged by the logarithm, a store opened anew goes on, and what no longer holds is gone."""
    shape = Shape(3, "0.6")
    qs = questions(13, 120)
    had = []
    for b in range(4):
        store = history.SegmentStore(spark, str(tmp_path), shape, entries_a_part=100)
        batch = [(b * 30 + i, q) for i, q in enumerate(qs[b * 30 : b * 30 + 30])]
        got = {r[0] for r in store.ingest(spark.createDataFrame(batch, "i bigint, q string"), "i", "q").collect()}
        assert got == {i for i, q in batch if any(near(q, r, 3, 6, 10) for j, r in had + batch if j < i)}
        had += batch
    assert store.ingest(spark.createDataFrame([], "i bigint, q string"), "i", "q").count() == 0
    names = {p.name for p in tmp_path.iterdir()}
    held = store.manifest.segments
    assert len(held) < 3 and sum(x.texts for x in held) == sum(len({words(q) for q in qs[b : b + 30]}) for b in (0, 30, 60, 90)) and held[0].bits > 3
    assert {n for n in names if n.startswith(("segment", "manifest", "order"))} == {*(x.name for x in held), "manifest-4", store.manifest.order}
    for r in store._arrays_of(held[0].name).collect():
        suffix = history._unpack(r.suffix, history.np.uint64)
        assert (history.np.diff(suffix.astype(object)) >= 0).all() and {int(x) >> (64 - held[0].bits) for x in suffix} == {r.part}


def test_interrupted_ingest_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = history.SegmentStore(spark, str(tmp_path), Shape(3, "0.6"))
    df = spark.createDataFrame([(1, "one two three four"), (2, "one two three four")], "i bigint, q string")
    monkeypatch.setattr(store, "_commit", lambda new: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.ingest(df, "i", "q")
    again = history.SegmentStore(spark, str(tmp_path), Shape(3, "0.6"))
    assert [r[0] for r in again.ingest(df, "i", "q").collect()] == [2]


def test_small_batch_reads_few_parts(spark, tmp_path, monkeypatch):
    """A batch of two texts against 3,000: the scan of the arrays names few of the parts, isn't shuffled, and few entries are read."""
    store = history.SegmentStore(spark, str(tmp_path), Shape(3, "0.6"), entries_a_part=200)
    rng = random.Random(5)
    old = [(i, sentences(rng, 3)) for i in range(3000)]
    store.ingest(spark.createDataFrame(old, "i bigint, q string"), "i", "q", check=False)
    read = []
    arrays_of = store._arrays_of

    def watch(name, parts=None):
        df = arrays_of(name, parts)
        if parts is not None and name == store.manifest.segments[0].name:
            read.append((len(parts), df.agg({"n": "sum"}).first()[0], df))
        return df

    monkeypatch.setattr(store, "_arrays_of", watch)
    new = [(9001, old[7][1] + " indeed"), (9002, sentences(rng, 3))]
    assert [r[0] for r in store.ingest(spark.createDataFrame(new, "i bigint, q string"), "i", "q").collect()] == [9001]
    parts, entries, df = read[0]
    every = arrays_of(store.manifest.segments[0].name).agg({"n": "sum"}).first()[0]
    assert parts * 5 < 1 << store.manifest.segments[0].bits and entries * 5 < every
    assert "part" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_frequent_items_across_batches():
    """Fifty batches that each hold a shingle three times: it is counted whole."""
    from loomstone.llm import shingles

    one = history.pd.DataFrame({"words": ["a b c"] * 3 + ["d e f g h"]})
    (out,) = shingles._count_batches(3)(iter([one] * 50))
    assert 150 in set(out.loc[out["kind"] == 1, "n"])
    many = shingles.FrequentItems(50)
    rng = history.np.random.default_rng(1)
    for _ in range(40):
        many.add(*history.np.unique(history.np.r_[history.np.full(40, 7, history.np.uint64), rng.integers(100, 10**9, 360).astype(history.np.uint64)], return_counts=True))
    got = dict(zip(many.h.tolist(), many.n.tolist(), strict=True))
    assert len(got) <= 50 and 1600 - many.total // 50 <= got[7] <= 1600


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in pathlib.Path(d).rglob("shuffle_*.data")}


def test_disk_of_an_ingest_is_given_back(spark, tmp_path, monkeypatch):
    """Shuffle files and tables between steps of an ingest don't pile up beside the store, and no join shuffles the store's arrays."""
    monkeypatch.setattr(history, "BROADCAST_ENTRIES", 0)
    store = history.SegmentStore(spark, str(tmp_path), Shape(3, "0.6"))
    qs = questions(19, 95)
    store.ingest(spark.createDataFrame(list(enumerate(qs[:75])), "i bigint, q string"), "i", "q", check=False)
    scans = []
    arrays_of = store._arrays_of
    monkeypatch.setattr(store, "_arrays_of", lambda *a: scans.append(a) or arrays_of(*a))
    files, tables = _shuffle_files(spark), set(scratch.names(spark, scratch.scratch_dir(spark)))
    new = [(100 + i, q) for i, q in enumerate(qs[75:])]
    got = {r[0] for r in store.ingest(spark.createDataFrame(new, "i bigint, q string"), "i", "q").collect()}
    assert got == {i for i, q in new if any(near(q, r, 3, 6, 10) for r in qs[:75]) or any(near(q, r, 3, 6, 10) for j, r in new if j < i)}
    until = time.time() + 10
    while _shuffle_files(spark) - files and time.time() < until:  # executors remove them a little later
        time.sleep(0.2)
    assert not _shuffle_files(spark) - files
    left = set(scratch.names(spark, scratch.scratch_dir(spark))) - tables
    assert not {n for n in left if not n.startswith("counts")}
    assert not scans


@pytest.mark.parametrize("first", [1000, 2])
def test_rounds_of_bounded_size(spark, monkeypatch, first):
    """Probes that match much are searched in rounds, none of many more matches than the store has entries, and no pair is lost."""
    monkeypatch.setattr(history, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(history, "HITS_AT_ONCE", 0)
    monkeypatch.setattr(history, "SPREAD_ENTRIES", 5)
    monkeypatch.setattr(history, "FIRST_MATCHES", first)
    sizes = []
    covered = history.SegmentStore._covered

    def watch(self, hits):
        sizes.append((hits.count(), sum(x.words for x in self.manifest.segments)))
        return covered(self, hits)

    monkeypatch.setattr(history.SegmentStore, "_covered", watch)
    rng = random.Random(8)
    qs = [f"it is market day again and {rng.choice(NOUNS)} {rng.choice(NOUNS)} are {rng.choice(NOUNS)} and {rng.choice(NOUNS)}" for _ in range(90)]
    old, new = qs[:40], [(i, 0, q) for i, q in enumerate(qs[40:])]
    assert seen(spark, old, new, Shape(3, "0.6")) == brute(old, new, Shape(3, "0.6")) != set()
    assert all(n <= 4 * words for n, words in sizes) and sum(n for n, _ in sizes) > 0 and len(sizes) > 2


def test_rarest_are_the_rarest_of_the_store(spark):
    """By their counts, not by estimates: a suffix of usual words that is rare together goes before one of rarer words."""
    counts = [(1, p, 100 + p, w) for p, w in enumerate([9, 1, 5, 3, 7, 1, 8, 2, 6, 4])] + [(1, 0, 100, 4), (1, -1, 7, 2), (2, 0, 5, 1), (2, -1, 8, 1)]
    got = history._rarest(spark.createDataFrame(counts, history.COUNTS), Shape(3, "0.6", hits=1)).collect()
    assert {tuple(r) for r in got} == {(1, 103, 10, 3), (1, 107, 10, 2), (1, 109, 10, 4), (1, 7, 0, 2)}
