"""Seeded samples, splits, running totals and batches, without sorting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.scratch import materialise

ROWS_A_BUCKET = 50_000
MOST_GROUPS = 1_000_000


def random_key(seed: int, *parts: Column) -> Column:
    """A number in [0, 2^60) that depends on the seed and the parts only: the same on every cluster, and in SQL."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _sent(groups: DataFrame) -> DataFrame:
    """A written table with a row for each group, to be broadcast where that is a million rows at most, so that a large group isn't gathered by a join."""
    return F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups


def smallest_keys(rows: DataFrame, group: list[str], row_id: str, key: Column, quotas: DataFrame, quota: str, weight: str | None = None) -> DataFrame:
    """Of every group the rows with the smallest random keys: as many as its quota, or, with weight, while the weight before them is below it.

    The keys of a group are cut into buckets of some 50,000 rows, counted before the shuffle; whole buckets below the
    quota are taken as they are, and only the bucket in which it ends is sorted. So a group that holds a third of all rows
    is never in one task. quotas has a row for each group. Null groups match null groups; ties in the key go by row_id.
    Keys are made once and written in the shared folder, as they are read three times.
    """
    amount = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = materialise(rows.withColumn("__k", key).withColumn("__w", F.coalesce(amount, F.lit(0))), "keys")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]
    plan = quotas.select(*group, F.col(quota).cast("bigint").alias("__q")).alias("p").join(sizes.alias("s"), same("p", "s")).select("p.*", F.ceil(F.col("__n") / ROWS_A_BUCKET).cast("bigint").alias("__b"))
    plan = _sent(materialise(plan, "quotas"))
    placed = rows.alias("r").join(plan.alias("p"), same("r", "p")).select("r.*", "__q", "__b").withColumn("__bucket", F.floor(F.col("__k").cast("double") / float(1 << 60) * F.col("__b")).cast("bigint"))
    counted = placed.groupBy(*group, "__bucket", "__q").agg(F.sum("__w").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = counted.withColumn("__before", before).where("__before < __q").withColumn("__whole", F.col("__before") + F.col("__sum") <= F.col("__q")).drop("__q", "__sum")
    edges = _sent(materialise(edges, "edges"))
    open_rows = placed.alias("r").join(edges.alias("e"), [*same("r", "e"), F.col("r.__bucket") == F.col("e.__bucket")]).select("r.*", "__before", "__whole")
    inside = open_rows.where("__whole").drop("__before", "__whole")
    within = F.coalesce(F.sum("__w").over(W.partitionBy(*group, "__bucket").orderBy("__k", row_id).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = open_rows.where("not __whole").withColumn("__at", F.col("__before") + within).where("__at < __q").drop("__at", "__before", "__whole")
    return inside.unionByName(edge).drop("__k", "__q", "__b", "__bucket", "__w")


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the smallest keys (a top-n on the key: each task keeps n rows)."""
    return df.withColumn("__k", random_key(seed, F.col(row_id))).orderBy("__k", row_id).limit(n).drop("__k")


def split_by_share(df: DataFrame, row_id: str, share: float, seed: int = 42, first: str = "test", rest: str = "train") -> DataFrame:
    """Adds split: ceil(share * n) rows with the smallest keys are `first`."""
    one = df.withColumn("__all", F.lit(1))
    quotas = one.groupBy("__all").agg(F.ceil(F.round(F.count("*") * F.lit(share), 6)).cast("bigint").alias("q"))
    picked = smallest_keys(one.select(row_id, "__all"), ["__all"], row_id, random_key(seed, F.col(row_id)), quotas, "q").select(row_id, F.lit(first).alias("split"))
    return df.join(picked, row_id, "left").withColumn("split", F.coalesce("split", F.lit(rest)))


def stratified_split(df: DataFrame, row_id: str, difficulty: str, hard_target: int = 40, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split. easy and medium: max(1, int(n * ratio)) rows to test; hard: min(hard_target, n). Other difficulties stay in train."""
    sizes = df.groupBy(difficulty).agg(F.count("*").alias("n")).where(F.col(difficulty).isin("easy", "medium", "hard"))
    wanted = F.when(F.col(difficulty) == "hard", F.least(F.lit(hard_target), F.col("n"))).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio))))
    quotas = sizes.select(difficulty, wanted.cast("bigint").alias("q"))
    picked = smallest_keys(df.select(row_id, difficulty), [difficulty], row_id, random_key(seed, F.col(row_id)), quotas, "q").select(row_id, F.lit("test").alias("split"))
    return df.join(picked, row_id, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def running_before(df: DataFrame, order: str, amount: str | None = None, out: str = "before", tie: str | None = None) -> DataFrame:
    """Adds the sum of `amount` (1 each by default) of all rows before a row in the order of a column. Nulls in the order come first.

    Rows are cut into stretches of some 50,000 by the column's approximate quantiles, so neither outliers nor crowded values leave one
    stretch with most rows; only rows of equal order lie in one stretch whatever their number. Sums of stretches are added up first, so each
    task sorts one stretch.
    """
    size = F.coalesce(F.col(amount), F.lit(0)) if amount else F.lit(1)
    steps = max(1, min(10_000, df.where(F.col(order).isNotNull()).count() // ROWS_A_BUCKET))
    cuts = df.agg(F.percentile_approx(order, [(i + 1) / (steps + 1) for i in range(steps)], 100 * steps)).first()[0] or []
    # how many cuts lie below the row: a binary search over a sorted array of constants
    at = F.when(F.col(order).isNull(), -1).otherwise(_cuts_below(F.col(order), sorted(set(cuts)))) if cuts else F.when(F.col(order).isNull(), -1).otherwise(0)
    cut = df.withColumn("__at", at.cast("int"))
    sums = cut.groupBy("__at").agg(F.sum(size).alias("__s"))
    offsets = sums.select("__at", F.coalesce(F.sum("__s").over(W.orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    within = F.coalesce(F.sum(size).over(W.partitionBy("__at").orderBy(*[c for c in (order, tie) if c]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(offsets), "__at").withColumn(out, F.col("__o") + within).drop("__at", "__o")  # a row for each stretch


def _cuts_below(value: Column, cuts: list) -> Column:
    """The number of cuts below a value, as nested comparisons of logarithmic depth."""
    if not cuts:
        return F.lit(0)
    if len(cuts) > 64:  # more than that is an interpreted search, which keeps the expression small
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))
    mid = len(cuts) // 2
    return F.when(value > F.lit(cuts[mid]), F.lit(mid + 1) + _cuts_below(value, cuts[mid + 1 :])).otherwise(_cuts_below(value, cuts[:mid]))


def cap_at_group_end(df: DataFrame, group: str, amount: str, cap: int) -> DataFrame:
    """Rows of the groups, in group order, before whose first row less than `cap` was taken."""
    sums = df.groupBy(group).agg(F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("__t"))
    kept = running_before(sums, group, "__t").where(F.col("before") < cap).select(group)
    return df.join(kept, group, "left_semi")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: the number of the fixed-size batch of each row in the order of a whole-number column."""
    return running_before(df, order).withColumn("batch", F.floor(F.col("before") / size).cast("bigint")).drop("before")
