"""Scoring of generated answers: metrics by condition, inference compression, failure categories and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(flag: Column, digits: int = 4) -> Column:
    """Share of true over all rows of a group, at least one row counted."""
    return F.round(F.sum(F.coalesce(flag, F.lit(False)).cast("int")) / F.greatest(F.count("*"), F.lit(1)), digits)


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, mean tokens, and parse validity (of condition B only) of each group."""
    valid = F.when(F.first("condition") == "B", rate(F.col("parse_valid"))) if by == ["condition"] else rate(F.col("parse_valid"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"), F.round(F.avg("reasoning_tokens"), 1).alias("mean_reasoning_tokens"), valid.alias("parse_validity_rate"))


def inference_compression(rows: DataFrame) -> DataFrame:
    """Mean tokens of conditions A and B by dataset and their ratio; null where one is missing or A's mean is 0."""
    a, b = (F.avg(F.when(F.col("condition") == c, F.col("reasoning_tokens"))) for c in "AB")
    means = rows.groupBy("dataset").agg(F.round(a, 1).alias("mean_a"), F.round(b, 1).alias("mean_b"))
    return means.withColumn("ratio", F.when(F.col("mean_a") > 0, F.round(F.col("mean_b") / F.col("mean_a"), 4)))


def failure_category(parse_valid: Column, err_kind: Column, correct: Column) -> Column:
    return F.when(~parse_valid, F.coalesce(err_kind, F.lit("PARSE_ERROR"))).when(~correct, "WRONG_ANSWER").otherwise("CORRECT")


def iteration_signals(rows: DataFrame, by: str, category: str) -> DataFrame:
    """(by, signals): HIGH_PARSE_ERROR above 10 %, UNKNOWN_SYMBOL and ARITY_MISMATCH where any, HIGH_WRONG_ANSWER above 15 %."""
    n = lambda c: F.count(F.when(F.col(category) == c, 1))
    counted = rows.groupBy(by).agg(F.count("*").alias("n"), *[n(c).alias(c) for c in ("PARSE_ERROR", "UNKNOWN_SYMBOL", "ARITY_MISMATCH", "WRONG_ANSWER")])
    signals = F.array_compact(
        F.array(
            F.when(F.col("PARSE_ERROR") > F.col("n") * 0.1, "HIGH_PARSE_ERROR"),
            F.when(F.col("UNKNOWN_SYMBOL") > 0, "UNKNOWN_SYMBOL"),
            F.when(F.col("ARITY_MISMATCH") > 0, "ARITY_MISMATCH"),
            F.when(F.col("WRONG_ANSWER") > F.col("n") * 0.15, "HIGH_WRONG_ANSWER"),
        )
    )
    return counted.select(by, F.array_join(signals, ",").alias("signals"))


def quality_rate(rows: DataFrame, category: str) -> DataFrame:
    """(good, judged, rate): OK and VERBOSE over all but SKIP."""
    good = F.count(F.when(F.col(category).isin("OK", "VERBOSE"), 1))
    judged = F.count(F.when(F.col(category) != "SKIP", 1))
    return rows.agg(good.alias("good"), judged.alias("judged")).withColumn("rate", F.round(F.col("good") / F.greatest("judged", F.lit(1)), 4))
