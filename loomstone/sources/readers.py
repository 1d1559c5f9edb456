"""Readers of question sets: rows of the sources' own shapes as (question, cot, answer) or (question, gold)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.answers import boxed
from loomstone.functions.text import strip


def marked_answers(df: DataFrame, question: str, answer: str) -> DataFrame:
    """answer holds reasoning, '####' and the answer; without the mark all is reasoning and the answer is empty."""
    has = F.instr(F.col(answer), "####") > 0
    parts = F.split(answer, "####")
    return df.select(F.col(question).alias("question"), F.when(has, strip(F.get(parts, F.lit(0)))).otherwise(strip(F.col(answer))).alias("cot"), F.when(has, strip(F.get(parts, F.lit(1)))).otherwise("").alias("answer"))


def choices(df: DataFrame, question: str, labels: str, texts: str, key: str) -> DataFrame:
    """The text of the choice whose label is the key, the first where none is; the question stands for the reasoning."""
    at = F.greatest(F.array_position(labels, F.col(key)), F.lit(1))
    return df.select(F.col(question).alias("question"), F.col(question).alias("cot"), F.get(texts, (at - 1).cast("int")).alias("answer"))


def yes_no(df: DataFrame, question: str, facts: str, answer: str) -> DataFrame:
    cot = F.when(F.size(facts) > 0, F.array_join(facts, " ")).otherwise(F.col(question))
    return df.select(F.col(question).alias("question"), cot.alias("cot"), F.when(F.col(answer), "yes").otherwise("no").alias("answer"))


def generic(df: DataFrame, questions: list[str], cots: list[str], answers: list[str]) -> DataFrame:
    """The first column that isn't null of each list, else an empty string."""
    pick = lambda names: F.coalesce(*[F.col(c).cast("string") for c in names], F.lit(""))
    return df.select(pick(questions).alias("question"), pick(cots).alias("cot"), pick(answers).alias("answer"))


def eval_rows(df: DataFrame, kind: str, question: str, answer: str) -> DataFrame:
    """(question, gold): 'marked' takes what follows '####', 'boxed' the last boxed value, others the answer as it is."""
    parts = F.split(answer, "####")
    gold = {"marked": F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1)))).otherwise(F.col(answer)), "boxed": boxed(F.col(answer))}.get(kind, F.col(answer).cast("string"))
    return df.select(F.col(question).alias("question"), gold.alias("gold"))
