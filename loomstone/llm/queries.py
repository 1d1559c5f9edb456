"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.llm import defects, history, layout, leaks, lookalike, mixture, overlap, quota, terms, tokens
from loomstone.llm.shingles import Shape
from loomstone.plans.registry import Query, table

# --- problem 1 ---------------------------------------------------------------------------------------------------------
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = quota.split_quotas(table(spark, sf_dir, "split_stats"), table(spark, sf_dir, "corpus"))
    return quotas.where("shortfall > 0").select("run_id", "difficulty").distinct()


def p1_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = quota.split_quotas(table(spark, sf_dir, "split_stats"), table(spark, sf_dir, "corpus"))
    return quotas.select("run_id", "difficulty", "pool", "asked", "quota", "shortfall")


def p1_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas that come to the number of test rows an earlier run took: remainders, least numbers, caps and refill."""
    quotas = quota.proportional_quotas(table(spark, sf_dir, "split_stats"), table(spark, sf_dir, "corpus"))
    return quotas.select("run_id", "difficulty", "pool", "asked", "quota", "shortfall")


def p1_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.draw_test_rows(table(spark, sf_dir, "split_stats"), table(spark, sf_dir, "corpus"))


def _level_sql(source: str, low: str, high: str, out: str) -> str:
    """SQL beside the operator: the sum at every bend is worked out category by category, in place of running sums."""
    return f"""
{out}_b as (select run_id, difficulty, {low}::double as lo0, {high}::double as hi0, w as w0, size, sum({low}) over (partition by run_id) > size as tight from {source}),
{out}_c as (select run_id, difficulty, size, case when tight then lo0 else w0 end as w, case when tight then 0.0 else lo0 end as lo, case when tight then lo0 else greatest(lo0, hi0) end as hi from {out}_b),
{out}_g as (select run_id, least(any_value(size), sum(case when w > 0 then hi else lo end)) as goal from {out}_c group by run_id),
{out}_e as (select run_id, lo / w as at from {out}_c where w > 0 union select run_id, hi / w from {out}_c where w > 0),
{out}_f as (select e.run_id, e.at, sum(least(greatest(e.at * c.w, c.lo), c.hi)) as f, sum(case when c.w > 0 and c.lo / c.w <= e.at and e.at < c.hi / c.w then c.w else 0 end) as slope
            from {out}_e e join {out}_c c using (run_id) group by e.run_id, e.at),
{out}_l as (select f.run_id, arg_max(f.at + case when slope > 1e-12 then (goal - f) / slope else 0 end, f.at) as level from {out}_f f join {out}_g g using (run_id) where f <= goal + 1e-9 group by f.run_id),
{out}_r as (select c.run_id, c.difficulty, g.goal, least(greatest(coalesce(level, 0) * w, lo), hi) as x from {out}_c c join {out}_g g using (run_id) left join {out}_l l using (run_id)),
{out}_p as (select *, floor(x + 1e-6) as whole, round(greatest(x - floor(x + 1e-6), 0), 6) as part from {out}_r),
{out} as (select run_id, difficulty, (whole + case when part > 0 and row_number() over (partition by run_id order by part desc, difficulty) <= goal - sum(whole) over (partition by run_id) then 1 else 0 end)::bigint as n from {out}_p)
"""


P1_REQUESTS = """
with asked as (
  select distinct run_id, batch_id, coalesce(hard_test_target, 0) as hard_want, coalesce(easy_medium_test_ratio, 0.0) as ratio,
         coalesce(min_per_difficulty, 0) as least, d.difficulty
  from split_stats, (values ('easy'), ('medium'), ('hard')) d(difficulty) where run_id is not null),
pools as (select batch_id, difficulty, count(*) as n from corpus group by all),
wanted as (
  select a.run_id, a.batch_id, a.difficulty, coalesce(p.n, 0) as pool,
         cast(case when a.difficulty = 'hard' then hard_want else greatest(least, floor(ratio * coalesce(p.n, 0))) end as bigint) as asked
  from asked a left join pools p on p.batch_id = a.batch_id and p.difficulty = a.difficulty)
"""

# --- problems 2 and 3 ----------------------------------------------------------------------------------------------------
QUESTIONS = Shape(3, "0.6")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = table(spark, sf_dir, "cot_examples")
    return history.seen_before(table(spark, sf_dir, "corpus"), "corpus_id", "question", examples, "example_id", "batch_no", "question", QUESTIONS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, sf_dir, "corpus"), "corpus_id", "question", "split", shape=QUESTIONS)
    return pairs.select(F.col("id_a").alias("corpus_id_a"), F.col("id_b").alias("corpus_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "split_stats").agg(F.sum("test_n").alias("test_n"))
    return overlap.overlap_report(table(spark, sf_dir, "corpus"), "corpus_id", "question", "split", "source", tests, shape=QUESTIONS)


# --- problems 4 and 9 -------------------------------------------------------------------------------------------------------
def p4_row_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables: kind tells them apart; a document's tokens are text_tokens, a corpus row's chain_tokens and cot_tokens."""
    none = F.lit(None).cast("bigint")
    slices = ["source", "lang", "subject"]
    corpus = tokens.token_counts(table(spark, sf_dir, "corpus", python=True), "corpus_id", {"chain_tokens": "neuralese_chain", "cot_tokens": "original_cot"}, slices)
    docs = tokens.token_counts(table(spark, sf_dir, "documents", python=True), "doc_id", {"text_tokens": "text"}, slices)
    corpus = corpus.select(F.lit("corpus").alias("kind"), F.col("corpus_id").alias("id"), *slices, "chain_tokens", "cot_tokens", none.alias("text_tokens"))
    docs = docs.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), *slices, none.alias("chain_tokens"), none.alias("cot_tokens"), "text_tokens")
    return corpus.unionByName(docs)


def p4_slice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_totals(p4_row_tokens(spark, sf_dir), ["kind", "source", "lang", "subject"], ["chain_tokens", "cot_tokens", "text_tokens"])


def _mixture(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    sizes = mixture.document_tokens(table(spark, sf_dir, "documents", python=True), "doc_id", "source", "text")
    return mixture.mixture(sizes, "doc_id", "source", "tokens", table(spark, sf_dir, "source_weights"), **how)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix at the target shares."""
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.reached(*_mixture(spark, sf_dir), "doc_id")


# A budget midway between the limits at target shares (that of p9_mix) and at the sources' own shares: the scarcest source would
# repeat more than it may at target shares, so the exponent is bisected to the repetition limit.
REPEATS = {"repeat_share": 0.5}
# Between the entropies of the own and of the target shares of the test tables.
ENTROPY = {"wanted_entropy": 1.7}


def p9_mix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, plan = _mixture(spark, sf_dir, **REPEATS)
    return mix.join(F.broadcast(plan.select("source", "exponent")), "source")


def p9_shares_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.reached(*_mixture(spark, sf_dir, **REPEATS), "doc_id")


def p9_shares_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.reached(*_mixture(spark, sf_dir, **ENTROPY), "doc_id")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix bisected to the repetition limit, for every listed source: no document used too often, the budget met
    to within one document, weights that are the tempered shares at the exponent, and an exponent below 1 that leaves no room."""
    mix, plan = _mixture(spark, sf_dir, **REPEATS)
    weights = table(spark, sf_dir, "source_weights").groupBy("source").agg(F.max("max_repeats").alias("most"))
    uses = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("pass").alias("passes_in"), F.max("tokens").alias("size"))
    sums = uses.groupBy("source").agg(F.max("uses").alias("uses"), F.bool_and(F.col("uses") == F.col("passes_in")).alias("once"), F.sum(F.col("uses") * F.col("size")).alias("used"), F.max("size").alias("longest"))
    total = Window.partitionBy()
    own = F.col("tokens_there") / F.sum("tokens_there").over(total)
    raw = F.when((F.col("tokens_there") > 0) & (F.col("target_share") > 0), F.pow(F.col("target_share"), F.col("exponent")) * F.pow(own, 1 - F.col("exponent"))).otherwise(0.0)
    both = plan.join(weights, "source").join(sums, "source", "left").withColumn("raw", raw)
    fullest = F.max(F.when(F.col("tokens_there") > 0, F.col("goal") / (F.col("most") * F.col("tokens_there")))).over(total)
    return both.select(
        "source",
        (F.coalesce("uses", F.lit(0)) <= F.col("most")).alias("repeats_kept"),
        F.coalesce("once", F.lit(True)).alias("once_a_pass"),
        ((F.col("goal") == 0) | (F.coalesce("used", F.lit(0)) - F.col("goal")).between(0, F.col("longest"))).alias("budget_met"),
        (F.abs(F.col("weight") - F.col("raw") / F.sum("raw").over(total)) < 1e-9).alias("weight_tempered"),
        ((F.col("exponent") < 1) & (F.abs(fullest - 1) < 1e-3)).alias("limit_binds"),
    )


# --- problem 5 ---------------------------------------------------------------------------------------------------------


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus", python=True).select(F.col("corpus_id").alias("id"), "question", "neuralese_chain")
    return corpus.union(layout.read_lines(table(spark, sf_dir, "corpus_lines"), "line_id", "raw_line", ["question", "neuralese_chain"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_copies(p5_records(spark, sf_dir), "id", "question", "neuralese_chain")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_groups(p5_records(spark, sf_dir), "id", "question", "neuralese_chain")


P5_MEMBERS = r"""
with records as (
  select corpus_id as id, question as q, neuralese_chain as c from corpus
  union all
  select line_id, case when json_type(raw_line, '$.question') = 'VARCHAR' then json_extract_string(raw_line, '$.question') end,
         case when json_type(raw_line, '$.neuralese_chain') = 'VARCHAR' then json_extract_string(raw_line, '$.neuralese_chain') end
  from corpus_lines where json_valid(raw_line)),
worded as (
  select distinct id, regexp_extract_all(lower(q), '[\p{L}\p{N}]+') as qw, regexp_extract_all(lower(c), '[\p{L}\p{N}]+') as cw
  from records where q is not null and c is not null),
members as (select id, min(id) over (partition by qw, cw) as first_id, count(*) over (partition by qw, cw) as n from worded where len(qw) > 0 and len(cw) > 0)
"""


# --- problem 6 ---------------------------------------------------------------------------------------------------------
def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus")
    return terms.mark_terms(terms.term_frequencies(corpus, terms.symbol_terms(F.col("neuralese_chain"))), corpus)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


P6_TERMS = """
with used as (
  select corpus_id, unnest(list_filter(regexp_extract_all(upper(neuralese_chain), '[A-Z0-9_]+'), lambda t: regexp_matches(t, '^[A-Z]'))) as term
  from (select row_number() over () as corpus_id, neuralese_chain from corpus)),
counts as (select term, count(*) as occurrences, count(distinct corpus_id) as records from used group by term),
marked as (
  select term, occurrences, records,
         case when records <= 2 then 'rare' when records > 0.2 * (select count(*) from corpus) then 'common' end as mark from counts)
"""


# --- problems 7 and 8 -------------------------------------------------------------------------------------------------------
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defective_pairs(table(spark, sf_dir, "corpus", python=True), "corpus_id", "question", "neuralese_chain", "answer")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents", python=True), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


# --- problem 10 --------------------------------------------------------------------------------------------------------
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents", python=True), "doc_id", "text")


def p10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_groups(table(spark, sf_dir, "documents", python=True), "doc_id", "text")


GRAMS = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
WORDS = r"regexp_extract_all(lower(question), '[\p{L}\p{N}]+')"

P3_PAIRS = f"""
with q as (select distinct corpus_id, split, {WORDS} as w from corpus where question is not null and split in ('train', 'test')),
s as (select corpus_id, split, w, {GRAMS} as grams from q),
g as (select corpus_id, split, len(grams) as n, unnest(grams) as gram from s),
near as (select a.corpus_id as e, b.corpus_id as t from g a join g b on a.gram = b.gram and a.split = 'test' and b.split = 'train'
         group by a.corpus_id, b.corpus_id, a.n, b.n having count(*) * 10 >= 6 * (a.n + b.n - count(*))),
same as (select a.corpus_id as e, b.corpus_id as t from s a join s b on a.w = b.w and a.split = 'test' and b.split = 'train'),
pairs as (select distinct least(e, t) as corpus_id_a, greatest(e, t) as corpus_id_b from (select * from near union all select * from same) where e <> t)
"""

P2_FOUND = f"""
with q as (
  select 'c' || corpus_id as id, null as example_id, -1 as batch, {WORDS} as w from corpus where question is not null
  union all
  select 'e' || example_id, example_id, coalesce(batch_no, 2147483647), {WORDS} from cot_examples where question is not null),
s as (select distinct *, {GRAMS} as grams from q),
g as (select id, example_id, batch, len(grams) as n, unnest(grams) as gram from s),
near as (select a.example_id from g a join g b on a.gram = b.gram and a.id <> b.id
         where a.example_id is not null and (b.batch < a.batch or (b.batch = a.batch and b.example_id < a.example_id))
         group by a.example_id, b.id, a.n, b.n having count(*) * 10 >= 6 * (a.n + b.n - count(*))),
same as (select a.example_id from s a join s b on a.w = b.w and a.id <> b.id
         where a.example_id is not null and (b.batch < a.batch or (b.batch = a.batch and b.example_id < a.example_id)))
select distinct example_id from (select * from near union all select * from same)
"""


def form_sql(column: str) -> str:
    """The one form of problem 10 in SQL. Representatives don't matter for equality; here they are the Latin letters."""
    pairs = {p[0]: p[1] for p in lookalike.LOOKALIKE_LETTERS.split()} | dict.fromkeys(lookalike.HYPHENS, "-") | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    for cp in range(0x370, 0x530):  # composed letters of the other alphabets, on a base that has a Latin twin
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in pairs and len(twin := unicodedata.normalize("NFC", pairs[parts[0]] + parts[1:])) == 1:
            pairs[chr(cp)] = twin
    old, new = "".join(pairs).replace("'", "''"), "".join(pairs.values()).replace("'", "''")
    clean = f"regexp_replace(regexp_replace({column}, '[\\p{{Cf}}\\x{{34F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({clean}), '{old}', '{new}'))"


P8_FOUND = rf"""
with d as (select distinct doc_id, regexp_extract_all(lower({form_sql("text")}), '[\p{{L}}\p{{N}}]+') as w from documents where text is not null),
i as (select distinct item_id, regexp_extract_all(lower({form_sql("text")}), '[\p{{L}}\p{{N}}]+') as w from eval_items where text is not null),
dr as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as run from d),
ir as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as run from i),
found as (select distinct doc_id, item_id from dr join ir using (run))
"""

P10_FOUND = f"""
with f as (select distinct doc_id, text, {form_sql("text")} as form from documents where text is not null),
pairs as (select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id)
select doc_id_a, doc_id_b from pairs
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_quotas": p1_quotas,
        "p1_proportions": p1_proportions,
        "p1_draw": p1_draw,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_row_tokens": p4_row_tokens,
        "p4_slice_totals": p4_slice_totals,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p6_terms": p6_terms,
        "p7_found": p7_found,
        "p8_found": p8_found,
        "p8_items": p8_items,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p9_mix_repeats": p9_mix_repeats,
        "p9_shares_repeats": p9_shares_repeats,
        "p9_shares_entropy": p9_shares_entropy,
        "p9_checks": p9_checks,
        "p10_found": p10_found,
        "p10_groups": p10_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_REQUESTS + "select distinct run_id, difficulty from wanted where asked > pool",
        "p1_quotas": P1_REQUESTS + "select run_id, difficulty, pool, asked, least(asked, pool) as quota, greatest(asked - pool, 0) as shortfall from wanted",
        "p1_proportions": P1_REQUESTS
        + """, shares as (
  select w.run_id, w.difficulty, w.pool, case when w.difficulty = 'hard' then a.hard_want else a.ratio * w.pool end as w, case when w.difficulty = 'hard' then 0 else a.least end as least0, s.test_n
  from wanted w join asked a using (run_id, difficulty) join (select distinct run_id, test_n from split_stats) s using (run_id)),
sized as (select *, coalesce(test_n::bigint, round(sum(greatest(w, least0)) over (partition by run_id))::bigint) as size from shares),"""
        + _level_sql("sized", "least0", "greatest(size, least0)", "asked_n")
        + ","
        + _level_sql("sized", "least(least0, pool)", "pool", "quota_n")
        + "select s.run_id, s.difficulty, s.pool, a.n as asked, q.n as quota, greatest(a.n - s.pool, 0) as shortfall from sized s join asked_n a using (run_id, difficulty) join quota_n q using (run_id, difficulty)",
        "p1_draw": P1_REQUESTS
        + """, keyed as (
  select w.run_id, c.corpus_id, c.difficulty, w.asked,
         row_number() over (partition by w.run_id, c.difficulty
                            order by cast('0x' || substr(md5('42|' || w.run_id || '|' || c.corpus_id), 1, 15) as bigint), c.corpus_id) as turn
  from corpus c join wanted w on w.batch_id = c.batch_id and w.difficulty = c.difficulty)
select run_id, corpus_id, difficulty from keyed where turn <= asked""",
        "p2_found": P2_FOUND,
        "p3_found": P3_PAIRS + "select corpus_id_a, corpus_id_b from pairs",
        "p3_report": P3_PAIRS
        + """, ends as (select corpus_id_a as id from pairs union all select corpus_id_b from pairs), links as (select id, count(*) as n from ends group by id)
select c.split, c.source, count(*) as records, sum(l.n)::bigint as pairs, case when c.split = 'test' then count(*) / (select sum(test_n) from split_stats) end as share_of_test
from links l join corpus c on c.corpus_id = l.id group by c.split, c.source""",
        "p5_found": P5_MEMBERS + "select first_id, id as copy_id from members where id <> first_id",
        "p5_groups": P5_MEMBERS + "select distinct first_id, n as copies from members",
        "p8_found": P8_FOUND + "select doc_id, item_id from found",
        "p8_items": P8_FOUND + "select item_id, count(*) as documents, min(doc_id) as first_doc from found group by item_id",
        "p9_checks": "select distinct source, true as repeats_kept, true as once_a_pass, true as budget_met, true as weight_tempered, true as limit_binds from source_weights where source is not null",
        "p10_found": P10_FOUND,
        "p10_groups": f"""
with f as (select distinct doc_id, text, {form_sql("text")} as form from documents where text is not null),
g as (select *, min(doc_id) over (partition by form) as first_id, count(*) over (partition by form) as n_docs from f),
n as (select form, count(distinct text) as n_texts from f group by form having count(distinct text) > 1)
select doc_id, first_id, n_texts, n_docs from g join n using (form)""",
        "p6_found": P6_TERMS + "select term, mark from marked where mark is not null",
        "p6_terms": P6_TERMS + "select term, occurrences, records, mark from marked",
    }
