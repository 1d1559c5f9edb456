"""Problem 9: mixing sources to target weights.

Weights follow a temperature: between the sources' own token shares (exponent 0) and the target shares (exponent 1) they
are target^a * own^(1 - a), normalised. With equal targets this is the usual own^(1/T). The exponent is bisected to the
entropy asked for, or to the largest at which no source repeats more than it may. Each source then fills its budget with
permutations of its blocks of documents: whole passes, and of the last one as many blocks as the budget holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm import common
from loomstone.llm.tokens import token_counts
from loomstone.operators.sampling import random_key

STEPS = 60
MAX_SOURCES = 100_000
BLOCK_DOCUMENTS = 1_000
MOST_BLOCKS = 100_000


def tempered(own: list[float], target: list[float], exponent: float) -> list[float]:
    """target^a * own^(1-a), normalised; a source with nothing, or without a target, gets nothing."""
    raw = [math.exp(exponent * math.log(t) + (1 - exponent) * math.log(o)) if t > 0 and o > 0 else 0.0 for o, t in zip(own, target, strict=True)]
    total = sum(raw)
    return [x / total for x in raw] if total else raw


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect_entropy(own: list[float], target: list[float], wanted: float) -> float:
    """The exponent in [0, 1] at which the weights' entropy comes closest to `wanted` nats on the way from own to target shares."""
    low, high = 0.0, 1.0
    rising = entropy(tempered(own, target, 1.0)) >= entropy(tempered(own, target, 0.0))
    for _ in range(STEPS):
        mid = (low + high) / 2
        below = entropy(tempered(own, target, mid)) < wanted
        low, high = (mid, high) if below == rising else (low, mid)
    return (low + high) / 2


def bisect_repeats(own: list[float], target: list[float], repeats: list[float], budget: float) -> float:
    """The largest exponent in [0, 1] at which budget * weight stays within repeats * tokens for every source; 0 if none does."""

    def fits(a: float) -> bool:
        return all(budget * w <= r * o * (1 + 1e-12) for w, o, r in zip(tempered(own, target, a), own, repeats, strict=True))

    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def plan_mixture(tokens: dict[str, int], weights: dict[str, tuple[float, int]], budget: int | None = None, wanted_entropy: float | None = None) -> list[dict]:
    """One row a source of `weights`: target share, tokens there, weight, token budget, whole passes and the rest.

    Without a budget, it is the largest at which every source with documents has its target share (absent sources' shares
    go to the others in proportion), so the exponent is 1. With a budget, or an entropy, the exponent is bisected.
    `limited_by` names the source whose tokens and repeats bind such a budget, null where none does.
    """
    names = sorted(weights)
    have = [float(tokens.get(s, 0)) for s in names]
    total = sum(have)
    own = [h / total if total else 0.0 for h in have]
    present = [max(0.0, weights[s][0]) if h > 0 and weights[s][1] > 0 else 0.0 for s, h in zip(names, have, strict=True)]
    share_sum = sum(present)
    target = [p / share_sum if share_sum else 0.0 for p in present]
    repeats = [float(max(0, weights[s][1])) for s in names]
    exponent = 1.0
    if wanted_entropy is not None:
        exponent = bisect_entropy(own, target, wanted_entropy)
    scarce = None
    if budget is None:
        now = tempered(own, target, exponent)
        most, scarce = min(((r * h / w, s) for s, w, h, r in zip(names, now, have, repeats, strict=True) if w > 0), default=(0.0, None))
        budget = int(most)
    elif wanted_entropy is None:
        exponent = bisect_repeats(have, target, repeats, float(budget))
    final = tempered(own, target, exponent)
    plan = []
    for s, h, w, r in zip(names, have, final, repeats, strict=True):
        goal = min(int(budget * w + 0.5), int(r * h))
        whole = int(goal // h) if h else 0
        plan.append({"source": s, "target_share": float(weights[s][0]), "tokens_there": int(h), "weight": w, "goal": goal, "passes": whole, "rest": goal - whole * int(h), "exponent": exponent, "limited_by": scarce})
    return plan


PLAN = "source string, target_share double, tokens_there bigint, weight double, goal bigint, passes int, rest bigint, exponent double, limited_by string"


def mixture(docs: DataFrame, doc_id: str, source: str, tokens: str, weights: DataFrame, seed: int = 42, budget: int | None = None, wanted_entropy: float | None = None, repeat_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, plan). mix: (doc_id, source, tokens, pass, place), a row for each use of a document; (pass, place) orders the mix.

    docs has the size of each document in `tokens` (null and negative sizes count as 0 and such documents aren't used);
    weights has source, target_share and max_repeats. Rows with a null id, a null source or one without weight aren't
    used; of a repeated row (same id) the one whose source and tokens sort first is the document. The documents of a source lie in blocks; every
    pass takes the blocks in a permutation of its own, and the last one stops where the budget is met, going over it by less
    than one document, so no document is used more than max_repeats times. repeat_share: in place of a budget, how far it lies
    between that at target shares (0) and that at which the sources' own shares are used up (1).
    Only the sources' sums come to the driver: more than 100,000 sources are refused.
    """
    spark = docs.sparkSession
    wanted = weights.select(F.col("source").cast("string").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most")).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = {r.source: (float(r.share), int(r.most)) for r in wanted}
    listed = spark.createDataFrame([(s,) for s in goals], "source string")
    named = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.col(tokens).cast("bigint").alias("tokens")).where("id is not null and source is not null and tokens > 0")
    plain = named.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("id", "d.*").join(F.broadcast(listed), "source", "left_semi")
    plain = common.materialise(plain, "sizes")
    sums = {r.source: (int(r.t), int(r.n)) for r in plain.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    have = {s: t for s, (t, _) in sums.items()}
    rows = plan_mixture(have, goals, budget, wanted_entropy)
    if repeat_share is not None:
        used = [r for r in rows if r["weight"] > 0]
        least, own = sum(r["goal"] for r in used), min((goals[r["source"]][1] for r in used), default=0) * sum(r["tokens_there"] for r in used)
        rows = plan_mixture(have, goals, int(least + repeat_share * (own - least)))
    plan = spark.createDataFrame([tuple(r.values()) for r in rows], PLAN)
    blocks_of = {s: min(MOST_BLOCKS, -(-n // BLOCK_DOCUMENTS)) for s, (_, n) in sums.items()}
    steps = spark.createDataFrame([(r["source"], r["passes"], r["rest"], blocks_of[r["source"]]) for r in rows if r["goal"] > 0], "source string, passes int, rest bigint, blocks int")
    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")
    placed = plain.join(F.broadcast(steps), "source").withColumn("block", block)
    # of the last pass: which blocks are in, and where the budget ends. At most 100,000 blocks a source are put in order.
    turn = lambda n: random_key(seed, n, F.col("source"), F.col("block"))
    sizes = placed.where("rest > 0").groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy(turn(F.col("passes") + 1), "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = sizes.withColumn("before", before).where("before < rest").select("source", "block", "before", (F.col("before") + F.col("t") <= F.col("rest")).alias("whole"))
    taken = placed.where("rest > 0").join(taken, ["source", "block"])
    inner = lambda n: random_key(seed, n, F.col("id"))
    within = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy(inner(F.col("passes") + 1), "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = taken.where("not whole").withColumn("at", F.col("before") + within).where("at < rest")  # one block of each source
    last = taken.where("whole").select("id", "source", "tokens", "block", (F.col("passes") + 1).alias("pass")).unionByName(edge.select("id", "source", "tokens", "block", (F.col("passes") + 1).alias("pass")))
    every = placed.where("passes > 0").select("id", "source", "tokens", "block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    # blocks of all sources are shuffled together; within its block, a document has its own place
    place = F.struct(turn(F.col("pass")).alias("block"), inner(F.col("pass")).alias("document"))
    mix = every.unionByName(last).withColumn("place", place).drop("block")
    return mix.withColumnRenamed("id", doc_id), plan


def reached(mix: DataFrame, plan: DataFrame, doc_id: str, tolerance: float = 0.02) -> DataFrame:
    """(source, target_share, tokens_there, weight, exponent, limited_by, tokens_used, reached_share, documents, most_uses, met): what the mix came to.

    met: whether the share reached differs from the target share by at most `tolerance` of it. A listed source without
    documents has a share of 0 and isn't met.
    """
    uses = mix.groupBy("source", doc_id).agg(F.count("*").alias("uses"), F.sum("tokens").alias("t"))
    sums = uses.groupBy("source").agg(F.sum("t").alias("tokens_used"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = plan.join(sums, "source", "left").withColumn("total", F.sum(zero("tokens_used")).over(W.partitionBy()))  # a row for each source
    share = F.when(F.col("total") > 0, zero("tokens_used") / F.col("total")).otherwise(0.0)
    return out.select("source", "target_share", "tokens_there", "weight", "exponent", "limited_by", zero("tokens_used").alias("tokens_used"), share.alias("reached_share"), zero("documents").alias("documents"), zero("most_uses").alias("most_uses"), (F.abs(share - F.col("target_share")) <= F.lit(tolerance) * F.col("target_share")).alias("met"))


def document_tokens(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, tokens) with sizes by the tokenizer."""
    return token_counts(docs, doc_id, {"tokens": text}, [source])
