"""Problem 3: same or near-same records across splits, by a bipartite prefix-filter join on rare shingles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import common
from loomstone.llm.shingles import Shape, could_match, enough, near, prefix_table, rare_first

HOT_TEXT = 100_000
TEXT_KEY = ["k1", "k2", "n"]


@dataclass
class Links:
    """members: (id, trains, tid, *kept) of the records whose text has a link; texts: (t_eval, t_train), the linked texts."""

    members: DataFrame
    texts: DataFrame


def _links(df: DataFrame, record_id: str, text: str, split: str, train: str, evaluation: str, shape: Shape, kept: list[str]) -> Links:
    words = common.word_text(F.col(text).cast("string"))
    rows = df.where(F.col(split).isin(train, evaluation)).select(F.col(record_id).cast("bigint").alias("id"), (F.col(split) == train).alias("trains"), words.alias("words"), *[F.col(c).alias(f"kept_{c}") for c in kept]).where("id is not null and words is not null")
    keys = [k.alias(name) for k, name in zip(common.text_key(F.col("words")), TEXT_KEY, strict=True)]
    members = rows.select("id", "trains", *keys, *[f"kept_{c}" for c in kept]).distinct()
    texts = rows.groupBy("words").agg(F.min("id").alias("tid"), F.max("trains").alias("in_train"), F.max(~F.col("trains")).alias("in_eval"), F.count("*").alias("copies"))
    texts = common.materialise(texts, "overlap-texts")
    same = texts.where("in_train and in_eval").select(F.col("tid").alias("t_eval"), F.col("tid").alias("t_train"))
    found = common.materialise(same.unionByName(_near_texts(texts, shape)), "overlap-texts-found")
    ends = found.select(F.col("t_eval").alias("tid")).union(found.select("t_train")).distinct()
    wanted = common.materialise(texts.select("tid", *keys, "copies").join(ends, "tid", "left_semi"), "overlap-texts-linked")
    # texts of more than 100,000 records are joined by broadcast: there can't be more than one for each 100,000 records
    hot = wanted.where(F.col("copies") > HOT_TEXT).drop("copies")
    usual = wanted.where(F.col("copies") <= HOT_TEXT).drop("copies")
    if hot.isEmpty():
        placed = members.join(usual, TEXT_KEY)
    else:
        placed = members.join(F.broadcast(hot), TEXT_KEY).unionByName(members.join(F.broadcast(hot), TEXT_KEY, "left_anti").join(usual, TEXT_KEY))
    return Links(placed.select("id", "trains", "tid", *[F.col(f"kept_{c}").alias(c) for c in kept]), found)


def cross_split_pairs(df: DataFrame, record_id: str, text: str, split: str, train: str = "train", evaluation: str = "test", shape: Shape | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one record of each split, texts the same or near.

    Same: equal sequences of words, of any length (texts without a word are equal to each other). Near: at least
    shape.least of all distinct shingles in either text are in both. Null ids, null texts and other splits (null too)
    are left out. Repeated rows (same id) count once. Copies of a text are searched once and expanded at the end, for this form
    of the result only (see overlap_report); texts are read whole; empty tables give no row.
    """
    links = _links(df, record_id, text, split, train, evaluation, shape or Shape(), [])
    evals = links.members.where("not trains").select(F.col("id").alias("id_eval"), F.col("tid").alias("t_eval"))
    trains = links.members.where("trains").select(F.col("id").alias("id_train"), F.col("tid").alias("t_train"))
    pairs = links.texts.join(evals, "t_eval").join(trains, "t_train").where("id_eval <> id_train")
    return pairs.select(F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b")).distinct()


def _near_texts(texts: DataFrame, shape: Shape) -> DataFrame:
    """(t_eval, t_train) of different texts that are near; each text is an id and its words."""
    order = rare_first(texts, "words", shape.k)
    side = lambda where, t, probing: prefix_table(texts.where(where), "tid", "words", shape, order, probing).select(F.col("tid").alias(f"t_{t}"), F.col("size").alias(f"size_{t}"), F.col("rank").alias(f"rank_{t}"), "gram", "salt")
    index, probes = side("in_eval", "eval", False), side("in_train", "train", True)
    joined = index.join(probes, ["gram", "salt"]).where(F.col("t_eval") != F.col("t_train")).where(could_match(shape, F.col("size_eval"), F.col("rank_eval"), F.col("size_train"), F.col("rank_train")))
    shared = joined.groupBy("t_eval", "t_train").agg(F.count("*").alias("shared"), F.first("size_eval").alias("size_e"), F.first("size_train").alias("size_t"))
    candidates = shared.where(enough(shape, F.col("shared"), F.col("size_e"), F.col("size_t"))).select("t_eval", "t_train")
    a = texts.where("in_eval").select(F.col("tid").alias("t_eval"), F.col("words").alias("words_e"))
    b = texts.where("in_train").select(F.col("tid").alias("t_train"), F.col("words").alias("words_t"))
    return candidates.join(a, "t_eval").join(b, "t_train").where(near(shape)("words_e", "words_t")).select("t_eval", "t_train")


def overlap_report(df: DataFrame, record_id: str, text: str, split: str, source: str, test_rows: DataFrame, train: str = "train", evaluation: str = "test", shape: Shape | None = None) -> DataFrame:
    """(split, source, records, pairs, share_of_test): overlapping records of each split and source, and their pairs with the other split.

    From the links between texts and the number of records of each: pairs of copies are counted, never made. share_of_test divides the records by the
    single number in test_rows (column test_n), null where that is 0 or null. A record is an id with its split and source. Nulls as in
    cross_split_pairs; a null source is one of its own.
    """
    links = _links(df, record_id, text, split, train, evaluation, shape or Shape(), [source])
    counts = common.materialise(links.members.groupBy("tid", "trains", F.col(source).alias("source")).agg(F.count("*").alias("records")), "overlap-counts")

    def half(mine: str, other: str, trains: bool) -> DataFrame:
        there = counts.where(F.col("trains") != F.lit(trains)).groupBy("tid").agg(F.sum("records").alias("n")).withColumnRenamed("tid", f"t_{other}")
        partners = links.texts.join(there, f"t_{other}").groupBy(F.col(f"t_{mine}").alias("tid")).agg(F.sum("n").alias("partners"))
        sums = counts.where(F.col("trains") == F.lit(trains)).join(partners, "tid").groupBy("source").agg(F.sum("records").alias("records"), F.sum(F.col("records") * F.col("partners")).alias("pairs"))
        return sums.select(F.lit(train if trains else evaluation).alias("split"), "source", "records", "pairs")

    share = F.when((F.col("split") == evaluation) & (F.col("test_n") > 0), F.col("records") / F.col("test_n"))
    both = half("eval", "train", False).unionByName(half("train", "eval", True))
    return both.crossJoin(F.broadcast(test_rows)).select("split", "source", "records", "pairs", share.alias("share_of_test"))
