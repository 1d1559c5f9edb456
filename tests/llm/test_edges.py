"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator of the package."""

import pytest
from pyspark.sql import functions as F

from loomstone.llm import defects, history, layout, leaks, lookalike, mixture, overlap, quota, terms, tokens
from loomstone.llm.shingles import Shape

S3 = Shape(3, "0.6")
TEXTS = "rid bigint, body string, other string, grp string, part_name string"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat today", "(ADD 1 2)", "train", "a"),
    (2, "The  cat sat on the MAT, today!", "(ADD 1 2)", "test", "a"),
    (3, None, None, None, None),
    (4, "", "", "test", "b"),
    (5, " \t\n", "x", "train", "b"),
    (None, "the cat sat on the mat today", "(ADD 1 2)", "test", "a"),
    (6, LONG, LONG, "train", "c"),
    (7, LONG + " end", LONG, "test", "c"),
    (1, "the cat sat on the mat today", "(ADD 1 2)", "train", "a"),
]
CLASHES = "id a b h1 h2 words tid gram part text form term n source first_id key batch k0 t0 q c doc item pool w size trains _k _w".split()

OPERATORS = {
    "p2": lambda df: history.seen_before(df.where("grp = 'train'"), "rid", "body", df.withColumn("bn", F.lit(1)), "rid", "bn", "body", S3),
    "p3": lambda df: overlap.cross_split_pairs(df, "rid", "body", "grp", shape=S3),
    "p4": lambda df: tokens.token_counts(df, "rid", {"body_tokens": "body", "other_tokens": "other"}, ["grp"]),
    "p5": lambda df: layout.layout_copies(df, "rid", "body", "other"),
    "p5_groups": lambda df: layout.layout_groups(df, "rid", "body", "other"),
    "p6": lambda df: terms.mark_terms(terms.term_frequencies(df, terms.symbol_terms(F.col("other"))), df),
    "p7": lambda df: defects.defective_pairs(df, "rid", "body", "other", "other"),
    "p8": lambda df: leaks.leaked_items(df, "rid", "body", df.where("rid < 7"), "rid", "body"),
    "p9": lambda df: mixture.mixture(df.withColumn("sz", F.length("body")), "rid", "part_name", "sz", df.select(F.col("part_name").alias("source"), F.lit(0.5).alias("target_share"), F.lit(2).alias("max_repeats")))[0].withColumnRenamed("source", "src"),
    "p10": lambda df: lookalike.lookalike_pairs(df, "rid", "body"),
    "p10_groups": lambda df: lookalike.lookalike_groups(df, "rid", "body"),
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    df = spark.createDataFrame(ROWS, TEXTS)
    plain = rows(OPERATORS[name](df))
    wide = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    assert rows(OPERATORS[name](wide)) == plain
    assert rows(OPERATORS[name](df.limit(0))) == []
    nothing = spark.createDataFrame([(None, None, None, None, None)], TEXTS)
    out = rows(OPERATORS[name](nothing))
    assert out == [] or name in ("p4", "p6")
    if name != "p4":
        assert all(r[0] is not None for r in plain)


def test_expected_on_edges(spark):
    df = spark.createDataFrame(ROWS, TEXTS)
    # rows 4 and 5 have no words, so they are the same question; 6 and 7 are near
    assert rows(OPERATORS["p3"](df)) == [(1, 2), (4, 5), (6, 7)]
    assert rows(OPERATORS["p5"](df)) == [(1, 2)]
    assert (6,) in rows(OPERATORS["p2"](df)) and (3,) not in rows(OPERATORS["p2"](df))
    assert {r for r in rows(OPERATORS["p7"](df)) if r[0] in (3, 4)} == {(3, "empty"), (4, "empty")}
    assert [tuple(r) for r in OPERATORS["p4"](df).where("rid = 4").collect()] == [(4, "test", 0, 0)]
    assert {r[:2] for r in rows(OPERATORS["p8"](df))} == {(6, 6), (7, 6)}


def test_quota_edges(spark):
    runs = spark.createDataFrame([(1, "x", None, None, None), (2, None, 5, 0.5, 3), (3, "y", 2, 0.5, 1), (None, "y", 2, 0.5, 1), (3, "y", 2, 0.5, 1)], "run_id bigint, batch_id string, hard_test_target int, easy_medium_test_ratio double, min_per_difficulty int")
    corpus = spark.createDataFrame([(1, "y", "hard", "c"), (2, "y", "easy", "c"), (3, "y", "easy", "c"), (4, "y", None, "c"), (None, "y", "medium", "c"), (5, None, "hard", "c")], "corpus_id bigint, batch_id string, difficulty string, pool string")
    quotas = quota.split_quotas(runs, corpus)
    got = {(r.run_id, r.difficulty): (r.pool, r.asked, r.quota, r.shortfall) for r in quotas.collect()}
    assert got[(3, "hard")] == (1, 2, 1, 1)
    assert got[(3, "easy")] == (2, 1, 1, 0)
    assert got[(3, "medium")] == (1, 1, 1, 0)
    assert got[(2, "hard")] == (0, 5, 0, 5)
    assert got[(1, "easy")] == (0, 0, 0, 0)
    drawn = quota.draw_test_rows(runs, corpus).collect()
    assert sorted((r.run_id, r.difficulty) for r in drawn) == [(3, "easy"), (3, "hard")]
    assert quota.split_quotas(runs.limit(0), corpus).count() == 0
    assert quota.draw_test_rows(runs, corpus.limit(0)).count() == 0
