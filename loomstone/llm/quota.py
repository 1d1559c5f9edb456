"""Problem 1: samples that match target category proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.operators.sampling import random_key, smallest_keys


def allocate_quotas(pools: DataFrame, group: list[str], category: str, pool: str, want: str, floor: str | None = None, total: str | None = None, refill: bool = False) -> DataFrame:
    """Integer quotas for the categories of each group.

    pools has a row for each group and category: `pool` rows are there, `want` is the target weight, `floor` a least number
    for the category, `total` (a column, the same within a group; by default the sum over the categories of the larger of
    weight and floor, rounded) the size to draw. Every category is asked for its floor, or more in proportion to its weight, so that all
    come to the total; fractions go by largest remainder (ties: category order). Floors that come to more than the total share it
    in proportion. What is asked is capped at the pool; with refill, what capped categories can't give goes to the others in the
    same way, as far as pools allow; without, the size shrinks. Nulls in pool, want or floor, and negative numbers, count as 0; groups may be null.

    Returns the group, category, pool, asked (quota before the cap), quota, shortfall (asked - what the pool has).
    """
    whole = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")
    base = pools.select(*group, category, whole(pool).alias("pool"), F.greatest(F.coalesce(F.col(want), F.lit(0)), F.lit(0)).cast("double").alias("w"), (whole(floor) if floor else F.lit(0).cast("bigint")).alias("least"), (whole(total) if total else F.lit(None)).cast("bigint").alias("size"))
    by_default = F.round(F.sum(F.greatest("w", F.col("least").cast("double"))).over(W.partitionBy(*group))).cast("bigint")
    base = base.withColumn("size", F.coalesce("size", by_default))
    base = _in_proportion(base, group, category, F.col("least"), F.greatest("size", "least"), "asked")
    if refill:
        base = _in_proportion(base, group, category, F.least("least", "pool"), F.col("pool"), "quota")
    else:
        base = base.withColumn("quota", F.least("asked", "pool"))
    return base.select(*group, category, "pool", "asked", "quota", F.greatest(F.col("asked") - F.col("pool"), F.lit(0)).alias("shortfall"))


def _in_proportion(base: DataFrame, group: list[str], category: str, low: Column, high: Column, out: str) -> DataFrame:
    """Adds `out`: whole numbers between low and high that come to `size` (or as near as the bounds allow) in proportion to w.

    A level rises; every category stands at level * w, within its bounds. The sum over the categories is a line that bends
    where one leaves its lower bound or meets its upper one, so running sums over the bends give the level at which it is the
    size, without a loop.
    """
    every = W.partitionBy(*group)
    b = base.withColumn("lo", low.cast("double")).withColumn("hi", high.cast("double"))
    b = b.withColumn("lows", F.sum("lo").over(every)).withColumn("tight", F.col("lows") > F.col("size"))
    # lower bounds that don't fit become the upper ones, and the weights
    b = b.withColumn("v", F.when(F.col("tight"), F.col("lo")).otherwise(F.col("w"))).withColumn("hi", F.when(F.col("tight"), F.col("lo")).otherwise(F.greatest("lo", "hi"))).withColumn("lo", F.when(F.col("tight"), 0.0).otherwise(F.col("lo")))
    b = b.withColumn("lows", F.sum("lo").over(every)).withColumn("goal", F.least("size", F.sum(F.when(F.col("v") > 0, F.col("hi")).otherwise(F.col("lo"))).over(every)).cast("double"))
    bend = lambda at, slope, first: F.struct(F.when(F.col("v") > 0, F.col(at) / F.col("v")).otherwise(0.0).alias("at"), slope.alias("slope"), F.lit(first).alias("first"))
    b = b.withColumn("e", F.explode(F.array(bend("lo", F.col("v"), True), bend("hi", -F.col("v"), False))))
    along = every.orderBy("e.at")
    b = b.withColumn("slope", F.sum("e.slope").over(along)).withColumn("sum_there", F.col("lows") + F.col("e.at") * F.col("slope") - F.sum(F.col("e.slope") * F.col("e.at")).over(along))
    below = F.when(F.col("sum_there") <= F.col("goal") + 1e-9, F.struct(F.col("e.at").alias("at"), "sum_there", "slope"))
    b = b.withColumn("bend", F.max(below).over(every)).where("e.first")
    level = F.col("bend.at") + F.when(F.col("bend.slope") > 1e-12, (F.col("goal") - F.col("bend.sum_there")) / F.col("bend.slope")).otherwise(0.0)
    b = b.withColumn("real", F.least(F.greatest(F.coalesce(level, F.lit(0.0)) * F.col("v"), F.col("lo")), F.col("hi")))
    # a product like 16 * 0.1 / 0.1 may end just below a whole number
    b = b.withColumn("whole", F.floor(F.col("real") + 1e-6)).withColumn("part", F.round(F.greatest(F.col("real") - F.col("whole"), F.lit(0.0)), 6))
    b = b.withColumn("open", F.col("goal") - F.sum("whole").over(every)).withColumn("turn", F.row_number().over(every.orderBy(F.desc("part"), category)))
    more = F.when((F.col("turn") <= F.col("open")) & (F.col("part") > 0), 1).otherwise(0)
    return b.withColumn(out, (F.col("whole") + more).cast("bigint")).select(*base.columns, out)


def split_requests(runs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(run_id, batch_id, difficulty, pool, want, share, least, size): what each run of split_stats asks of each difficulty, and the rows of its batch.

    hard wants hard_test_target and has no least number; easy and medium want the ratio times the pool, rounded down (share: not
    rounded), and at least min_per_difficulty. size is the run's test_n. Null targets, ratios and minima count as 0. A difficulty without rows has a pool of 0; a null batch has none.
    """
    pools = corpus.select(F.col("batch_id").alias("b"), F.col("difficulty").alias("d")).where("b is not null and d in ('easy', 'medium', 'hard')").groupBy("b", "d").agg(F.count("*").alias("n"))
    asked = runs.select("run_id", "batch_id", F.coalesce("hard_test_target", F.lit(0)).alias("hard_want"), F.coalesce("easy_medium_test_ratio", F.lit(0.0)).alias("ratio"), F.coalesce("min_per_difficulty", F.lit(0)).alias("least"), *([F.col("test_n").alias("size")] if "test_n" in runs.columns else [F.lit(None).cast("int").alias("size")])).where("run_id is not null").distinct()
    asked = asked.withColumn("difficulty", F.explode(F.array(*map(F.lit, ("easy", "medium", "hard")))))
    both = asked.join(pools, (F.col("batch_id") == F.col("b")) & (F.col("difficulty") == F.col("d")), "left")
    pool, hard = F.coalesce(F.col("n"), F.lit(0)), F.col("difficulty") == "hard"
    share = F.when(hard, F.col("hard_want").cast("double")).otherwise(F.col("ratio") * pool)
    return both.select("run_id", "batch_id", "difficulty", pool.alias("pool"), F.floor(share).cast("bigint").alias("want"), share.alias("share"), F.when(hard, 0).otherwise(F.col("least")).alias("least"), "size")


def split_quotas(runs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Quotas and shortfalls of every run and difficulty: what is wanted, or the least number where that is more."""
    return allocate_quotas(split_requests(runs, corpus), ["run_id", "batch_id"], "difficulty", "pool", "want", "least")


def proportional_quotas(runs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Quotas of every run for the number of test rows an earlier run took (test_n; where that is null, what is wanted in all): shared out
    in proportion to what each difficulty wants, with its least number, and refilled from the others where a pool is too small."""
    return allocate_quotas(split_requests(runs, corpus), ["run_id", "batch_id"], "difficulty", "pool", "share", "least", "size", refill=True)


def draw_test_rows(runs: DataFrame, corpus: DataFrame, seed: int = 42) -> DataFrame:
    """(run_id, corpus_id, difficulty): the rows drawn for each run, by the smallest random keys. Rows without an id can't be drawn."""
    quotas = split_quotas(runs, corpus.where("corpus_id is not null")).where("quota > 0")
    rows = corpus.select("corpus_id", "batch_id", "difficulty").where("corpus_id is not null").join(quotas.select("run_id", "batch_id", "difficulty"), ["batch_id", "difficulty"])
    drawn = smallest_keys(rows, ["run_id", "difficulty"], "corpus_id", random_key(seed, F.col("run_id"), F.col("corpus_id")), quotas, "quota")
    return drawn.select("run_id", "corpus_id", "difficulty")
