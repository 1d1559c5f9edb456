"""Problem 6: frequency of every distinct value or term, and the terms too rare or too common to be useful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_RUNS = r"[A-Za-z0-9_]+"


def symbol_terms(text: Column) -> Column:
    """Longest runs of letters, digits and underscores that begin with a letter, in upper case, with repeats."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(SYMBOL_RUNS), 0), lambda t: t.rlike("^[A-Za-z]")), F.upper)


def term_frequencies(df: DataFrame, terms: Column) -> DataFrame:
    """(term, occurrences, records): how often each term occurs, and in how many rows.

    terms is an array column with repeats; null arrays and null terms count nothing. Every row emits each of its terms once, with its
    count in the row; sums of both are combined by hash before the shuffle.
    """
    # terms in order; where a run of equal ones ends, its count is what was there before it less than what is there with it
    runs = df.select(F.array_sort(F.filter(terms, lambda t: t.isNotNull())).alias("t"))
    ends = runs.select("t", F.filter(F.transform("t", lambda t, i: F.when(F.get("t", i + 1).eqNullSafe(t), 0).otherwise(i + 1)), lambda e: e > 0).alias("ends"))
    counts = ends.select(F.explode(F.transform("ends", lambda e, i: F.struct(F.get("t", e - 1).alias("term"), (e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("n")))).alias("x"))
    return counts.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.n").alias("occurrences"), F.count("*").alias("records"))


def mark_terms(frequencies: DataFrame, rows: DataFrame, rare_records: int = 2, common_share: float = 0.2) -> DataFrame:
    """Adds mark: 'rare' (in at most rare_records rows), 'common' (in more than common_share of the rows of `rows`), else null.

    A term that is both (in tiny tables) is rare. The number of rows, nulls included, is one row, so joining it costs nothing.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * F.col("n_rows"), "common")
    return frequencies.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("n_rows")
