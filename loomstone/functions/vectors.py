"""Vectors as arrays of floats: similarities in the JVM for short ones, block products in Python for all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.scratch import materialise


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; arrays of different length give null."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """a.b / (|a||b| + eps)."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def mean_vectors(df: DataFrame, group: list[str], vector: str, out: str = "mean") -> DataFrame:
    """The mean vector of each group: one row a group and dimension in between, combined before the shuffle. Null vectors and groups of nulls are left out."""
    flat = df.where(F.col(vector).isNotNull()).select(*group, F.posexplode(vector).alias("_d", "_x"))
    means = flat.groupBy(*group, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda p: p["_m"]).alias(out))


MOST_CENTRES = 10_000


def nearest(df: DataFrame, vector: str, centres: DataFrame, label: str, centre: str) -> DataFrame:
    """df with nearest (the label, a number, of the centre with the highest cosine; ties: the smallest) and similarity.

    The centres go to every executor; more than 10,000 are refused. Vectors are compared in blocks, by one matrix product each.
    Null vectors, and those of another length than the centres, have a null centre.
    """
    rows = centres.select(F.col(label).cast("bigint").alias("l"), F.col(centre).cast("array<double>").alias("c")).where("l is not null and c is not null").limit(MOST_CENTRES + 1).toPandas()
    if len(rows) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    rows = rows.sort_values("l", kind="stable")
    labels, every = rows["l"].to_numpy(np.int64), rows["c"].tolist()
    dims = len(every[0]) if every else 0
    m = np.array(every, np.float64).reshape(len(every), dims)
    lengths = np.linalg.norm(m, axis=1)

    @F.pandas_udf("nearest bigint, similarity double")
    def best(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"nearest": pd.array([None] * len(v), dtype="Int64"), "similarity": np.full(len(v), np.nan)})
        there = np.flatnonzero([x is not None and len(x) == dims and dims > 0 for x in v])
        for at in range(0, len(there), BLOCK):
            some = there[at : at + BLOCK]
            mine = _matrix(v.iloc[some])
            s = mine @ m.T / (np.outer(np.linalg.norm(mine, axis=1), lengths) + 1e-8)
            first = np.argmax(np.round(s, 12), axis=1)
            out.loc[some, "nearest"] = labels[first]
            out.loc[some, "similarity"] = s[np.arange(len(some)), first]
        return out

    scored = df.withColumn("__b", best.asNondeterministic()(F.col(vector)))
    return scored.withColumn("nearest", F.col("__b.nearest")).withColumn("similarity", F.nullif(F.col("__b.similarity"), F.lit(float("nan")))).drop("__b")


def top_k_per_group(df: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the highest score, ties by `tie`: pre-selected in each input partition, so a hot
    group sends k rows of each partition to the final sort."""
    from pyspark.sql import Window as W

    order = [F.desc(score), F.asc(tie)]
    part = df.withColumn("_part", F.spark_partition_id())
    local = part.withColumn("_rank", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_rank") <= k)
    return local.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k).drop("_part", "_rank")


BLOCK = 2048
PIVOT_SAMPLE = 4_096
MOST_PIVOTS = 1_024


def similar_pairs(df: DataFrame, vec_id: str, vector: str, threshold: float, seed: int = 42) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: all pairs of vectors with a cosine (norms + 1e-8 each) above the threshold.

    Exact, by cells around pivots: a vector lives with its nearest pivot and visits the later cells in which a vector within the
    threshold's angle can live (by the triangle inequality on angles: no farther from the pivot than the cell's radius
    plus the angle, nor than its own pivot's distance plus twice the angle). Cells are compared in blocks of 2,048
    vectors, so no task holds more than two blocks. Pivots (one for each 2,000 vectors, up to 1,024 or the square
    root of their number, so neither cells nor pivots grow as the vectors do) are drawn from a sample of four times as many; any choice is exact. Null ids and vectors are left out, and vectors of zeros have no pairs.
    The threshold must not be negative. The lower it is, the more cells a vector visits, up to all of them.
    """
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    plain = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null").dropDuplicates(["id"])
    pivots = _pivots(plain, seed)
    if pivots is None:
        return df.sparkSession.createDataFrame([], "id_a bigint, id_b bigint, similarity double")
    near = materialise(plain.mapInPandas(_place(pivots), "id bigint, v array<float>, cell int, gap double"), "cells")
    radii = np.full(len(pivots), -1.0)
    for r in near.groupBy("cell").agg(F.max("gap").alias("gap")).collect():  # a row for each pivot
        radii[r.cell] = r.gap
    members = near.mapInPandas(_visit(pivots, radii, float(np.arccos(min(1.0, threshold))) + 1e-6), "id bigint, v array<float>, cell int, home boolean")
    sizes = near.groupBy("cell").agg(F.count("*").alias("homes"))
    cut = members.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("homes") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a home block meets the home blocks from itself on; a visitor block meets every home block
    homes = cut.where("home").withColumn("x", block)
    left = homes.select("cell", "x", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1)).alias("y"), F.lit(0).alias("visit"), "id", "v", F.lit(0).alias("side"))
    right = homes.select("cell", F.explode(F.sequence(F.lit(0), F.col("x"))).alias("o"), F.col("x").alias("y"), F.lit(0).alias("visit"), "id", "v", F.lit(1).alias("side")).where("o < y").withColumnRenamed("o", "x")
    guests = cut.where("not home").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)))
    counts = guests.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    guests = guests.join(counts, "cell").withColumn("y", F.pmod("part", F.col("parts")).cast("int"))
    visiting = guests.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "y", F.lit(1).alias("visit"), "id", "v", F.lit(1).alias("side"))
    hosts = homes.join(counts, "cell").select("cell", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"), F.lit(1).alias("visit"), "id", "v", F.lit(0).alias("side"))
    every = left.unionByName(right).unionByName(visiting).unionByName(hosts)
    return every.groupBy("cell", "x", "y", "visit").applyInPandas(_pair_block(threshold), "id_a bigint, id_b bigint, similarity double")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64).reshape(len(v), -1)


def _unit(v: pd.Series) -> np.ndarray:
    m = _matrix(v)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def _pivots(plain: DataFrame, seed: int) -> np.ndarray | None:
    n = plain.count()
    most = max(1, min(max(MOST_PIVOTS, int(n**0.5)), -(-n // 2_000)))
    rows = plain.orderBy(F.xxhash64("id", F.lit(seed))).limit(max(PIVOT_SAMPLE, 4 * most)).select("v").toPandas()
    rows = rows[[bool(np.any(v)) for v in rows["v"]]] if len(rows) else rows
    if not len(rows):
        return None
    return _unit(rows["v"])[:most]


def _angles(v: pd.Series, pivots: np.ndarray) -> np.ndarray:
    m = _matrix(v)
    return np.arccos(np.clip(m / np.linalg.norm(m, axis=1, keepdims=True) @ pivots.T, -1.0, 1.0))


def _place(pivots: np.ndarray):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[bool(np.any(v)) for v in pdf["v"]]]
            if len(pdf):
                gaps = _angles(pdf["v"], pivots)
                cell = gaps.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), gap=gaps[np.arange(len(pdf)), cell])

    return place


def _visit(pivots: np.ndarray, radii: np.ndarray, angle: float):
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gaps = _angles(pdf["v"], pivots)
            own, cell = pdf["gap"].to_numpy()[:, None], pdf["cell"].to_numpy()[:, None]
            there = (radii >= 0) & (gaps <= np.minimum(radii + angle, own + 2 * angle)) & (np.arange(len(pivots)) > cell)
            row, to = np.nonzero(there)
            guests = pdf.iloc[row][["id", "v"]].assign(cell=to.astype(np.int32), home=False)
            yield pd.concat([pdf[["id", "v", "cell"]].assign(home=True), guests])

    return visit


def _pair_block(threshold: float):
    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y, visit = key
        alone = not visit and x == y
        a = pdf[pdf["side"] == 0]
        b = a if alone else pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id_a": pd.Series(dtype="int64"), "id_b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        sim = _unit(a["v"]) @ _unit(b["v"]).T
        i, j = np.nonzero(sim > threshold)
        p, q = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        keep = p < q if alone else np.ones(len(p), bool)
        return pd.DataFrame({"id_a": np.minimum(p, q)[keep], "id_b": np.maximum(p, q)[keep], "similarity": sim[i, j][keep]})

    return pairs


def greedy_keep(vectors: DataFrame, vec_id: str, confidence: str, pairs: DataFrame) -> DataFrame:
    """Rows that greedy near-duplicate removal keeps, in the order of their ids.

    An id still kept meets its later neighbours still kept; of each two, the one with less confidence goes, the later one
    on a tie, and an id that goes in its own turn goes on meeting the rest of its neighbours. The walk is
    sequential inside a connected group of pairs and independent between groups, so each group is walked in one task.
    """
    groups = components(pairs.select("id_a", "id_b"))
    conf = vectors.select(F.col(vec_id).alias("id"), F.col(confidence).cast("double").alias("c"))
    a = pairs.join(groups.withColumnRenamed("id", "id_a"), "id_a").join(conf.select(F.col("id").alias("id_a"), F.col("c").alias("c_a")), "id_a").join(conf.select(F.col("id").alias("id_b"), F.col("c").alias("c_b")), "id_b")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        pdf = pdf.sort_values(["id_a", "id_b"])
        for i, rows in pdf.groupby("id_a", sort=True):
            if i in gone:
                continue
            for j, ci, cj in zip(rows["id_b"], rows["c_a"], rows["c_b"], strict=True):
                if j not in gone:
                    gone.add(i if ci < cj else j)
        return pd.DataFrame({"gone": pd.Series(sorted(gone), dtype="int64")})

    gone = a.groupBy("component").applyInPandas(walk, "gone bigint")
    return vectors.join(gone, F.col(vec_id) == F.col("gone"), "left_anti")


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that each id is linked to, by repeated minima over neighbours and their own minima."""
    edges = pairs.toDF("a", "b")
    edges = edges.union(edges.select("b", "a")).distinct()
    state = edges.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        near = edges.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = state.join(near, "id").select("id", "component", F.least("component", "m").alias("m"))
        jump = step.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        new = step.join(jump, "m", "left").select("id", F.col("component").alias("old"), F.least("m", F.coalesce("mm", "m")).alias("component"))
        new = materialise(new, "components")
        changed = not new.where("old <> component").isEmpty()
        state = new.select("id", "component")
        if not changed:
            return state
    raise RuntimeError("components did not settle")

