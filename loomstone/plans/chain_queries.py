"""Queries on chains: those of the corpus, and chains rendered from lineitem whose verdicts are known by construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import chain as lang
from loomstone.functions import text
from loomstone.operators import corpus as build
from loomstone.operators import evaluation
from loomstone.plans.registry import query, table, with_share

# The kinds of chains rendered, their verdicts as they are and after repair.
TEMPLATES = (
    ("(ARITH_ADD {a} {b})", None, None),
    ("[(ARITH_MULTIPLY {a} {b}) (ARITH_EQUALS #x {a})]", None, None),
    ("(ARITH_ADD {a} {b} 1)", "ARITY_MISMATCH", "ARITY_MISMATCH"),
    ("(MYSTERY_OP {a} {b})", "UNKNOWN_SYMBOL", "UNKNOWN_SYMBOL"),
    ("(ARITH_ADD {a} {b}", "PARSE_ERROR", "ARITY_MISMATCH"),
    ("{(ARITH_EQUALS {a} {b}) | 1.5}", "PARSE_ERROR", "PARSE_ERROR"),
    ("ARITH_ADD {a} {b}", "PARSE_ERROR", None),
    ("(ARITH_ADD {a} {b}) (ARITH_EQUALS #t {a})", "PARSE_ERROR", None),
    ("(λ x:Numeric . (ARITH_LESS_THAN #x {a}))", None, None),
    ("[(ARITH_ADD {a} {b})]", "PARSE_ERROR", "PARSE_ERROR"),
)
_SQL_CASES = " ".join(f"when {k} then replace(replace('{t}', '{{a}}', a::varchar), '{{b}}', b::varchar)" for k, (t, _, _) in enumerate(TEMPLATES))
CHAINS = f"chains as (select k, a, b, case k {_SQL_CASES} end as chain from (select (l_orderkey * 7 + l_linenumber) % 10 as k, cast(l_quantity as int) as a, l_linenumber as b from lineitem))"


def verdict_sql(which: int) -> str:
    """The verdict of kind k (1: as it is, 2: repaired)."""
    return "case k " + " ".join(f"when {k} then '{t[which] or 'OK'}'" for k, t in enumerate(TEMPLATES)) + " end"


def chains(spark, sf):
    rows = table(spark, sf, "lineitem", python=True).select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10).alias("k"), F.col("l_quantity").cast("int").alias("a"), F.col("l_linenumber").alias("b"))
    rendered = None
    for k, (template, _, _) in enumerate(TEMPLATES):
        value = F.replace(F.replace(F.lit(template), F.lit("{a}"), F.col("a").cast("string")), F.lit("{b}"), F.col("b").cast("string"))
        rendered = F.when(F.col("k") == k, value) if rendered is None else rendered.when(F.col("k") == k, value)
    return rows.withColumn("chain", rendered)


def checker(spark, sf):
    return lang.validator(lang.signature_map(table(spark, sf, "signatures")))


def _verdicts(spark, sf, repaired=False):
    rows = chains(spark, sf)
    if repaired:
        rows = rows.withColumn("chain", lang.auto_repair("chain"))
    return rows.withColumn("v", checker(spark, sf)("chain")).select("k", "chain", F.coalesce("v.err_kind", F.lit("OK")).alias("verdict"), "v.err")


@query(f"with {CHAINS} select k, verdict, count(*) as n from (select k, {verdict_sql(2)} as verdict from chains) group by all")
def chain_repair_verdicts(spark, sf):
    return _verdicts(spark, sf, repaired=True).groupBy("k", "verdict").agg(F.count("*").alias("n"))


def flagship(spark, sf):
    return chain_repair_verdicts(spark, sf)


@query(f"with {CHAINS} select k, chain, {verdict_sql(1)} as verdict from chains")
def chain_verdicts(spark, sf):
    return _verdicts(spark, sf).select("k", "chain", "verdict")


@query(f"with {CHAINS} select verdict, count(*) as n from (select {verdict_sql(1)} as verdict from chains) group by verdict")
def chain_error_breakdown(spark, sf):
    return _verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"with {CHAINS} select k, a, b from chains where {verdict_sql(1)} = 'OK'")
def chain_validate_clean(spark, sf):
    rows = chains(spark, sf).withColumn("v", checker(spark, sf)("chain"))
    return rows.where("v.ok").select("k", "a", "b")


@query(f"""with {CHAINS}, v as (select k, {verdict_sql(1)} as verdict from chains)
  select sum(case when verdict = 'OK' then 1 else 0 end)::bigint as loose_valid, sum(case when verdict = 'OK' and k <> 1 then 1 else 0 end)::bigint as strict_valid,
  sum(case when k = 1 then 1 else 0 end)::bigint as newly_failing from v""")
def chain_strict_audit(spark, sf):
    """Signatures of the audit are its own, symbols are typed by the registry: numbers are Numeric, so operators on Numeric pass and an
    equation's #x can't be inferred. Kind 1 multiplies, for which this audit asks for an Entity. (corpus_strict_audit has the registered ones.)"""
    strict = {
        "ARITH_ADD": lang.Signature(2, ("Numeric", "Numeric"), "Numeric"),
        "ARITH_MULTIPLY": lang.Signature(2, ("Entity|Process", "Entity|Process"), "Numeric"),
        "ARITH_EQUALS": lang.Signature(2, ("Numeric|Entity", "Numeric"), "Relation"),
        "ARITH_LESS_THAN": lang.Signature(2, ("Numeric", "Numeric"), "Relation"),
    }
    paths = lang.ontology_map(table(spark, sf, "primitives"))
    rows = chains(spark, sf).withColumn("loose", lang.validator(strict)("chain")["ok"]).withColumn("strict", lang.validator(strict, paths)("chain")["ok"])
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return rows.agg(n(F.col("loose")).alias("loose_valid"), n(F.col("strict")).alias("strict_valid"), n(F.col("loose") & ~F.col("strict")).alias("newly_failing"))


@query(f"""with {CHAINS}, n as (select k, unnest(case k when 0 then [2] when 1 then [2, 2] when 2 then [3] when 3 then [2] when 8 then [2] end) as args,
   unnest(case k when 0 then ['ARITH_ADD'] when 1 then ['ARITH_MULTIPLY', 'ARITH_EQUALS'] when 2 then ['ARITH_ADD'] when 3 then ['MYSTERY_OP'] when 8 then ['ARITH_LESS_THAN'] end) as head from chains where k in (0, 1, 2, 3, 8))
  select head, case when head = 'MYSTERY_OP' then 'UNKNOWN_SYMBOL' when args <> 2 then 'ARITY_MISMATCH' else 'OK' end as verdict, count(*) as n from n group by all""")
def chain_nodes_arity(spark, sf):
    """The node table joined with the signatures: the check as a join, for registries of any size."""
    from loomstone.operators.registry import last_wins

    nodes = chains(spark, sf).select(F.explode(lang.parse_nodes("chain")).alias("n")).select("n.*").where("kind = 'application'")
    sigs = last_wins(table(spark, sf, "signatures").select("symbol", "arity", "pos"), ["symbol"], "pos")
    joined = nodes.join(F.broadcast(sigs) if sigs.count() < 100_000 else sigs, nodes["head"] == sigs["symbol"], "left")
    wrong = F.when(F.col("symbol").isNull(), "UNKNOWN_SYMBOL").when(F.col("n_args") != F.col("arity"), "ARITY_MISMATCH").otherwise("OK")
    return joined.select("head", wrong.alias("verdict")).groupBy("head", "verdict").agg(F.count("*").alias("n"))


@query(f"""with {CHAINS} select k, case k when 4 then '(ARITH_ADD ' || a || ')' when 6 then '(ARITH_ADD ' || a || ' ' || b || ')'
  when 7 then '[(ARITH_ADD ' || a || ' ' || b || ') (ARITH_EQUALS #t ' || a || ')]' when 8 then chain else chain end as repaired from chains""")
def chain_repair(spark, sf):
    return chains(spark, sf).select("k", lang.auto_repair("chain").alias("repaired"))


@query(f"""with {CHAINS}, s as (select k, chain, regexp_extract_all(chain, '\\(.*?\\)|\\{{.*?\\}}|\\[.*?\\]') as parts from chains)
  select k, count(*) as n, cast(sum(case when k in (2, 3, 5) then 1 when k in (1, 7, 0) then 0 else case when k in (8, 9) then 1 else 0 end end) as bigint) as failing from s group by k""")
def step_trace(spark, sf):
    """Steps of a chain, cut without regard to nesting; chains with a step that fails. Kind 9's step '[(ARITH_ADD a b)]' is cut at the inner ')'.

    A step is the shortest bracketed stretch, so '(λ x:Numeric . (ARITH_LESS_THAN #x a)' is one and can't be parsed.
    """
    steps = F.filter(text.find_all(F.col("chain"), r"\(.*?\)|\{.*?\}|\[.*?\]"), lambda s: s != "")
    rows = chains(spark, sf).withColumn("id", F.monotonically_increasing_id()).select("id", "k", F.posexplode_outer(steps).alias("pos", "step"))
    judged = rows.withColumn("bad", F.col("step").isNotNull() & ~checker(spark, sf)("step")["ok"])
    return judged.groupBy("id", "k").agg(F.max("bad").alias("bad")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("failing"))


@query(f"with {CHAINS} select split_part(err, ' ', 2) as head, count(*) as n from (select case k when 2 then 'ARITY_MISMATCH: ARITH_ADD expects' else 'UNKNOWN_SYMBOL: MYSTERY_OP' end as err from chains where k in (2, 3)) group by head")
def error_heads(spark, sf):
    failed = _verdicts(spark, sf).where("verdict in ('ARITY_MISMATCH', 'UNKNOWN_SYMBOL')")
    return failed.groupBy(text.error_head(F.col("err")).alias("head")).agg(F.count("*").alias("n"))


# Fixed value: the round-trip survival, in percent, from which hidden errors are taken off.
SURVIVAL = 88.6


# --- chains of the corpus: patterns ------------------------------------------------------------------------------------------
KNOWN = "(select distinct symbol from (select symbol from signatures union all select symbol from primitives) where symbol is not null)"


def known_symbols(spark, sf):
    return table(spark, sf, "signatures").select("symbol").union(table(spark, sf, "primitives").select("symbol")).where("symbol is not null").distinct()


def _corpus(spark, sf):
    return table(spark, sf, "corpus", python=True).where("neuralese_chain is not null").withColumnRenamed("neuralese_chain", "chain")


@query("select symbol, count(*) as n from (select unnest(regexp_extract_all(neuralese_chain, '[A-Z][A-Z0-9_]+')) as symbol from corpus) group by symbol")
def symbol_occurrences(spark, sf):
    return _corpus(spark, sf).select(F.explode(text.symbols(F.col("chain"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query(r"select symbol, count(*) as n from (select unnest(list_distinct(regexp_extract_all(neuralese_chain, '\b[A-Z][A-Z_]+[A-Z]\b'))) as symbol from corpus) group by symbol")
def symbol_distinct_rows(spark, sf):
    return _corpus(spark, sf).select(F.explode(F.array_distinct(text.symbols(F.col("chain"), 2))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


USED = "(select distinct unnest(regexp_extract_all(neuralese_chain, '[A-Z][A-Z0-9_]+')) as symbol from corpus)"


@query(f"select (select count(*) from {USED} join {KNOWN} using (symbol)) as used, (select count(*) from {KNOWN}) as known, round((select count(*) from {USED} join {KNOWN} using (symbol)) / (select count(*) from {KNOWN}), 6) as coverage")
def symbol_coverage(spark, sf):
    known = known_symbols(spark, sf)
    used = symbol_occurrences(spark, sf).join(known, "symbol", "left_semi").agg(F.count("*").alias("used"))
    return used.crossJoin(known.agg(F.count("*").alias("known"))).withColumn("coverage", F.round(F.col("used") / F.greatest("known", F.lit(1)), 6))


@query(f"select symbol from {KNOWN} where symbol not in (select symbol from {USED})")
def unused_symbols(spark, sf):
    return known_symbols(spark, sf).join(symbol_occurrences(spark, sf), "symbol", "left_anti")


@query(f"select symbol, n from (select symbol, count(*) as n from (select unnest(regexp_extract_all(neuralese_chain, '[A-Z][A-Z0-9_]+')) as symbol from corpus) group by symbol) order by n desc, symbol limit 20")
def top_symbols(spark, sf):
    return symbol_occurrences(spark, sf).orderBy(F.desc("n"), "symbol").limit(20)


def _leak_sql(version: int) -> str:
    source = "regexp_replace(neuralese_chain, '#[a-z][a-z0-9_]*', '', 'g')" if version == 1 else "neuralese_chain"
    words = rf"len(list_filter(regexp_extract_all({source}, '\b[a-z]{{4,}}\b'), lambda w: w not in ('true', 'false', 'null')))"
    return f"""select corpus_id from corpus where regexp_matches(neuralese_chain, '"[^"]{{4,}}"') or {words} > {2 if version == 1 else 3}"""


@query(_leak_sql(1))
def prose_leak_v1(spark, sf):
    return _corpus(spark, sf).where(text.prose_leak(F.col("chain"), 1)).select("corpus_id")


@query(_leak_sql(2))
def prose_leak_v2(spark, sf):
    return _corpus(spark, sf).where(text.prose_leak(F.col("chain"), 2)).select("corpus_id")


@query(r"select corpus_id from corpus where regexp_matches(neuralese_chain, '(^|[^(])[A-Z][A-Z_]{2,}\s+(\d[\d.]*|[A-Z][A-Z_]+)\s+(\d[\d.]*|[A-Z][A-Z_]+)\s*($|[^\s)])')")
def bare_head(spark, sf):
    return _corpus(spark, sf).where(text.bare_head(F.col("chain"))).select("corpus_id")


@query("select corpus_id, length(neuralese_chain) - length(replace(neuralese_chain, 'λ', '')) as lambdas from corpus where length(neuralese_chain) - length(replace(neuralese_chain, 'λ', '')) > 2")
def lambda_nesting(spark, sf):
    return _corpus(spark, sf).select("corpus_id", text.lambda_count(F.col("chain")).alias("lambdas")).where("lambdas > 2")


@query(rf"""with r as (select corpus_id, len(regexp_extract_all(neuralese_chain, '[^{text.SPACE}]+')) / greatest(len(regexp_extract_all(original_cot, '[^{text.SPACE}]+')), 1) as ratio,
    length(neuralese_chain) - length(replace(neuralese_chain, 'λ', '')) > 2 as nested from corpus where neuralese_chain is not null and original_cot is not null),
  s as (select distinct corpus_id, unnest(regexp_extract_all(neuralese_chain, '\b[A-Z][A-Z_]+[A-Z]\b')) as symbol from corpus where neuralese_chain is not null and original_cot is not null),
  u as (select distinct corpus_id from s where symbol not in (select symbol from {KNOWN}))
  select avg(ratio) <= 0.65 and max(ratio) <= 1.5 as ratio_ok, (select count(*) from u) / count(*) < 0.15 as unknown_ok, avg(case when nested then 1.0 else 0.0 end) < 0.10 as nesting_ok from r""")
def verdict_thresholds(spark, sf):
    rows = _corpus(spark, sf).where("original_cot is not null")
    ratio = text.token_count(F.col("chain")) / F.greatest(text.token_count(F.col("original_cot")), F.lit(1))
    sums = rows.select(ratio.alias("r"), (text.lambda_count(F.col("chain")) > 2).alias("nested")).agg(F.avg("r").alias("m"), F.max("r").alias("x"), F.avg(F.col("nested").cast("int")).alias("l"), F.count("*").alias("n"))
    used = rows.select("corpus_id", F.explode(F.array_distinct(text.symbols(F.col("chain"), 2))).alias("symbol"))
    unknown = used.join(known_symbols(spark, sf), "symbol", "left_anti").agg(F.countDistinct("corpus_id").alias("u"))
    return sums.crossJoin(unknown).select(((F.col("m") <= 0.65) & (F.col("x") <= 1.5)).alias("ratio_ok"), (F.col("u") / F.col("n") < 0.15).alias("unknown_ok"), (F.col("l") < 0.10).alias("nesting_ok"))


# --- chains of the corpus: verdicts (no SQL: the language isn't regular) ------------------------------------------------------
def _judged(spark, sf):
    return table(spark, sf, "corpus", python=True).withColumn("v", checker(spark, sf)("neuralese_chain"))


@query()
def corpus_validation(spark, sf):
    kinds = _judged(spark, sf).select(F.coalesce("v.err_kind", F.lit("OK")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))
    return with_share(kinds).select("verdict", "n", F.round(100 * F.col("share"), 1).alias("percent"))


@query()
def corpus_strict_audit(spark, sf):
    """Chains valid by arity, by types too, and the heads (fifteen at most) whose arguments fail only the types."""
    paths = lang.ontology_map(table(spark, sf, "primitives"))
    sigs = lang.signature_map(table(spark, sf, "signatures"))
    rows = table(spark, sf, "corpus", python=True).select(lang.validator(sigs)("neuralese_chain").alias("l"), lang.validator(sigs, paths)("neuralese_chain").alias("s"))
    heads = rows.where("l.ok and not s.ok").groupBy(text.error_head(F.col("s.err")).alias("head")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "head").limit(15)
    sums = rows.agg(F.count(F.when(F.col("l.ok"), 1)).alias("loose"), F.count(F.when(F.col("s.ok"), 1)).alias("strict"))
    return sums.select(F.explode(F.array(F.struct(F.lit("(loose)").alias("head"), F.col("loose").alias("n")), F.struct(F.lit("(strict)").alias("head"), F.col("strict").alias("n")))).alias("x")).select("x.*").union(heads)


@query()
def corpus_nodes(spark, sf):
    nodes = table(spark, sf, "corpus", python=True).select(F.explode(lang.parse_nodes("neuralese_chain")).alias("n")).select("n.*")
    return nodes.groupBy("kind", "head").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.max("n_args").alias("most_args"))


def _unknown_counts(spark, sf):
    used = _corpus(spark, sf).select("corpus_id", F.explode(F.array_distinct(text.symbols(F.col("chain"), 3))).alias("symbol"))
    return used.join(known_symbols(spark, sf), "symbol", "left_anti").groupBy("corpus_id").agg(F.count("*").alias("unknown"))


@query()
def spotcheck_flags(spark, sf):
    """Flags of the automatic check over the whole corpus, each with its share of rows and what is left of the round-trip survival without such rows."""
    ratio = text.token_count(F.col("neuralese_chain")) / F.greatest(text.token_count(F.col("original_cot")), F.lit(1))
    rows = _judged(spark, sf).select("corpus_id", "question", "answer", F.col("neuralese_chain").alias("chain"), "step_count", ratio.alias("ratio"), F.col("v.ok").alias("ok"))
    rows = rows.join(_unknown_counts(spark, sf), "corpus_id", "left").na.fill({"unknown": 0})
    flags = build.spot_flags(F.col("ok"), F.col("unknown"), F.col("ratio"), F.col("step_count"), F.col("question"), F.col("answer"), F.col("chain"))
    n = rows.agg(F.count("*").alias("t"))
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("flag", "n", F.round(100 * F.col("n") / F.col("t"), 1).alias("percent"), F.round(SURVIVAL - SURVIVAL * F.col("n") / F.col("t"), 1).alias("survival_without"))


@query()
def auto_flags(spark, sf):
    """Per row: INVALID with its kind, UNKNOWN symbols (five at most are named), EXPANSION where the ratio is above 1."""
    ratio = text.token_count(F.col("neuralese_chain")) / F.greatest(text.token_count(F.col("original_cot")), F.lit(1))
    used = _corpus(spark, sf).select("corpus_id", F.explode(F.array_distinct(text.symbols(F.col("chain"), 3))).alias("symbol")).join(known_symbols(spark, sf), "symbol", "left_anti")
    named = used.groupBy("corpus_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("symbol")), 1, 5), ",").alias("names"))
    rows = _judged(spark, sf).select("corpus_id", F.col("v.err_kind").alias("kind"), ratio.alias("ratio")).join(named, "corpus_id", "left")
    flags = F.array_compact(F.array(F.concat(F.lit("INVALID:"), F.col("kind")), F.concat(F.lit("UNKNOWN:"), F.col("names")), F.when(F.col("ratio") > 1.0, "EXPANSION")))
    return rows.select("corpus_id", flags.alias("flags")).where(F.size("flags") > 0)


@query(r"""with c as (select corpus_id, neuralese_chain as chain from corpus where neuralese_chain is not null),
  known as (select symbol from primitives where symbol is not null union select symbol from signatures where symbol is not null),
  m as (select corpus_id, unnest(range(1, len(a) + 1)) as i, a, g from (select corpus_id, regexp_extract_all(chain, '[A-Z][A-Z_]+[A-Z]') as a, regexp_split_to_array(chain, '[A-Z][A-Z_]+[A-Z]') as g from c) where len(a) > 0),
  s as (select corpus_id, i, a[i] as w, g[i] as before, g[len(a) + 1] as rest, a[i] in (select symbol from known) as ok from m)
  select corpus_id, string_agg(before || case when ok then w else '[!' || w || '!]' end, '' order by i) || any_value(rest) as marked from s group by corpus_id having not bool_and(ok)""")
def highlight_unknown(spark, sf):
    used = _corpus(spark, sf).select("corpus_id", F.explode(F.array_distinct(text.symbols(F.col("chain"), 3))).alias("symbol"))
    unknown = used.join(known_symbols(spark, sf), "symbol", "left_anti").groupBy("corpus_id").agg(F.collect_set("symbol").alias("unknown"))
    return _corpus(spark, sf).join(unknown, "corpus_id").select("corpus_id", lang.highlight("chain", "unknown").alias("marked"))


def _upper_variables(chain):
    """#name becomes #NAME, the inverse of lower_variables: a split at # leaves each name at the start of its piece."""

    def shout(piece, i):
        name = F.regexp_extract(piece, "^[a-z][a-z0-9_]*", 0)
        return F.when(i == 0, piece).otherwise(F.concat(F.upper(name), F.substr(piece, F.length(name) + 1)))

    return F.array_join(F.transform(F.split(chain, "#"), shout), "#")


def candidates(spark, sf):
    """Every chain as a model returns it: in a code fence, in rows of even id with the variables in capitals."""
    raw = F.when(F.col("corpus_id") % 2 == 0, _upper_variables(F.col("chain"))).otherwise(F.col("chain"))
    return _corpus(spark, sf).select("corpus_id", F.concat(F.lit("```lisp\n"), raw, F.lit("\n```")).alias("raw"))


def _pieces_sql(chain: str, pattern: str, case: str) -> str:
    """The names after each # in another case: text is split at #, and every piece but the first begins with its name."""
    return f"array_to_string(list_transform(string_split({chain}, '#'), lambda p, i: case when i = 1 then p else {case}(regexp_extract(p, '{pattern}')) || substr(p, length(regexp_extract(p, '{pattern}')) + 1) end), '#')"


_SHOUTED = _pieces_sql("neuralese_chain", "^[a-z][a-z0-9_]*", "upper")
_TRIMMED = f"regexp_replace(regexp_replace(raw, '^[{text.SPACE}]+', ''), '[{text.SPACE}]+$', '')"


@query(f"""with c as (select corpus_id, case when corpus_id % 2 = 0 then {_SHOUTED} else neuralese_chain end as raw from corpus where neuralese_chain is not null)
  select corpus_id, {_pieces_sql(_TRIMMED, "^[A-Z][A-Z0-9_]*", "lower")} as chain from c""")
def candidate_cleanup(spark, sf):
    """Chains out of their code fence, trimmed, #NAME made lower case: all chains, with white space at the ends and odd characters."""
    return candidates(spark, sf).select("corpus_id", lang.lower_variables(text.strip_fences(F.col("raw"))).alias("chain"))


@query(f"with {CHAINS} select k, count(*) as n, round(100.0 * count(*) / (select count(*) from chains), 2) as percent from chains group by k")
def category_percent(spark, sf):
    counts = chains(spark, sf).groupBy("k").agg(F.count("*").alias("n"))
    return with_share(counts).select("k", "n", F.round(100 * F.col("share"), 2).alias("percent"))


# --- evaluation: round trips stand for generated rows --------------------------------------------------------------------------
def eval_rows(spark, sf):
    """dataset is the source of the corpus row, condition the trip's number modulo 4 (A to D)."""
    rows = table(spark, sf, "corpus").select("corpus_id", F.coalesce("source", F.lit("none")).alias("dataset"))
    trips = table(spark, sf, "round_trip").distinct().join(rows, "corpus_id")
    condition = F.get(F.array(*map(F.lit, "ABCD")), (F.col("trip_id") % 4).cast("int"))
    return trips.select(
        "trip_id", "dataset", condition.alias("condition"), (F.col("outcome") == "SURVIVOR").alias("correct"), F.col("parse_error").isNull().alias("parse_valid"), text.error_kind(F.col("parse_error")).alias("err_kind"), F.coalesce(text.token_count(F.col("response")), F.lit(0)).alias("reasoning_tokens")
    )


EVAL = f"""e as (select r.trip_id, coalesce(c.source, 'none') as dataset, ['A', 'B', 'C', 'D'][1 + r.trip_id % 4] as condition, r.outcome = 'SURVIVOR' as correct, r.parse_error is null as parse_valid,
  split_part(r.parse_error, ':', 1) as err_kind, coalesce(len(regexp_extract_all(r.response, '[^{text.SPACE}]+')), 0) as reasoning_tokens
  from (select distinct * from round_trip) r join corpus c on c.corpus_id = r.corpus_id)"""


@query(f"""with {EVAL} select dataset, condition, count(*) as n, round(sum(case when correct then 1 else 0 end) / greatest(count(*), 1), 4) as accuracy, round(avg(reasoning_tokens), 1) as mean_reasoning_tokens,
  round(sum(case when parse_valid then 1 else 0 end) / greatest(count(*), 1), 4) as parse_validity_rate from e group by all""")
def eval_metrics(spark, sf):
    return evaluation.metrics(eval_rows(spark, sf), ["dataset", "condition"])


@query(f"""with {EVAL}, m as (select dataset, round(avg(case when condition = 'A' then reasoning_tokens end), 1) as mean_a, round(avg(case when condition = 'B' then reasoning_tokens end), 1) as mean_b from e group by dataset)
  select dataset, mean_a, mean_b, case when mean_a > 0 then round(mean_b / mean_a, 4) end as ratio from m""")
def inference_compression(spark, sf):
    return evaluation.inference_compression(eval_rows(spark, sf))


CATEGORY = "case when not parse_valid then coalesce(err_kind, 'PARSE_ERROR') when not coalesce(correct, false) then 'WRONG_ANSWER' else 'CORRECT' end"


def _categorised(spark, sf):
    category = evaluation.failure_category(F.col("parse_valid"), F.col("err_kind"), F.coalesce("correct", F.lit(False)))
    return eval_rows(spark, sf).withColumn("category", category)


@query(f"with {EVAL} select dataset, {CATEGORY} as category, count(*) as n from e group by all")
def failure_categories(spark, sf):
    return _categorised(spark, sf).groupBy("dataset", "category").agg(F.count("*").alias("n"))


@query(f"""with {EVAL}, c as (select dataset, {CATEGORY} as category from e), s as (select dataset, count(*) as n, count(*) filter (category = 'PARSE_ERROR') as p, count(*) filter (category = 'UNKNOWN_SYMBOL') as u,
  count(*) filter (category = 'ARITY_MISMATCH') as a, count(*) filter (category = 'WRONG_ANSWER') as w from c group by dataset)
  select dataset, array_to_string(list_filter([case when p > n * 0.1 then 'HIGH_PARSE_ERROR' end, case when u > 0 then 'UNKNOWN_SYMBOL' end, case when a > 0 then 'ARITY_MISMATCH' end, case when w > n * 0.15 then 'HIGH_WRONG_ANSWER' end], lambda x: x is not null), ',') as signals from s""")
def iteration_signals(spark, sf):
    return evaluation.iteration_signals(_categorised(spark, sf), "dataset", "category")


@query("""with r as (select case when discard_id % 11 = 0 then 'SKIP' when discard_reason like 'COMPRESSION%' then 'VERBOSE' when discard_reason like '%PARSE%' then 'BAD' else 'OK' end as c from discards)
  select count(*) filter (c in ('OK', 'VERBOSE')) as good, count(*) filter (c <> 'SKIP') as judged, round(count(*) filter (c in ('OK', 'VERBOSE')) / greatest(count(*) filter (c <> 'SKIP'), 1), 4) as rate from r""")
def quality_rate(spark, sf):
    c = F.when(F.col("discard_id") % 11 == 0, "SKIP").when(F.col("discard_reason").like("COMPRESSION%"), "VERBOSE").when(F.col("discard_reason").like("%PARSE%"), "BAD").otherwise("OK")
    return evaluation.quality_rate(table(spark, sf, "discards").select(c.alias("c")), "c")


# --- logs: lines rendered from discards --------------------------------------------------------------------------------------
def log_lines(spark, sf):
    said = F.when(F.col("discard_id") % 2 == 0, F.concat(F.lit("UNKNOWN_SYMBOL: "), F.upper("source"))).otherwise(F.concat(F.lit("ARITY_MISMATCH: ARITH_"), F.upper("source"), F.lit(" expects 2 args, got "), (F.col("discard_id") % 5).cast("string")))
    return table(spark, sf, "discards").where("source is not null").select("discard_id", F.concat(F.lit("INFO Step attempt "), (F.col("discard_id") % 3 + 1).cast("string"), F.lit("/3 failed: "), said).alias("line"))


LOG = """l as (select discard_id, 'INFO Step attempt ' || (discard_id % 3 + 1) || '/3 failed: ' || case when discard_id % 2 = 0 then 'UNKNOWN_SYMBOL: ' || upper(source) else 'ARITH' end as line, discard_id % 3 + 1 as attempt,
  case when discard_id % 2 = 0 then 'UNKNOWN_SYMBOL' else 'ARITY_MISMATCH' end as kind, case when discard_id % 2 = 0 then upper(source) else 'ARITH_' || upper(source) end as symbol from discards where source is not null)"""


def _read_log(spark, sf):
    line = F.col("line")
    kind = F.regexp_extract(line, r"(?i)attempt (\d)/3 failed: (\w+)", 2)
    symbol = F.coalesce(F.nullif(F.regexp_extract(line, r"UNKNOWN_SYMBOL: (\S+)", 1), F.lit("")), F.regexp_extract(line, r"ARITY_MISMATCH: (\S+) expects (\d+) args, got (\d+)", 1))
    return log_lines(spark, sf).select(F.regexp_extract(line, r"(?i)attempt (\d)/3 failed: (\w+)", 1).cast("bigint").alias("attempt"), kind.alias("kind"), symbol.alias("symbol"))


@query(f"with {LOG} select attempt, kind, count(*) as n from l group by all")
def log_failure_breakdown(spark, sf):
    return _read_log(spark, sf).groupBy("attempt", "kind").agg(F.count("*").alias("n"))


@query(f"""with {LOG}, a as (select symbol, count(*) as n from l where attempt = 1 group by symbol), b as (select symbol, count(*) as n from l where attempt > 1 and kind = 'ARITY_MISMATCH' group by symbol)
  select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.n, 0) as first_round, coalesce(b.n, 0) as later from a full join b on a.symbol = b.symbol""")
def round_compare(spark, sf):
    log = _read_log(spark, sf)
    first = log.where("attempt = 1").groupBy("symbol").agg(F.count("*").alias("first_round"))
    later = log.where("attempt > 1 and kind = 'ARITY_MISMATCH'").groupBy("symbol").agg(F.count("*").alias("later"))
    return first.join(later, "symbol", "full_outer").na.fill(0)


@query("""with l as (select discard_id as pos, 'line ' || case when discard_id % 500 = 120 then 'PHASE 4 starts' else 'text' end as line from discards)
  select distinct pos from l where pos >= (select min(pos) from l where contains(line, 'PHASE 4'))""")
def log_from_marker(spark, sf):
    line = F.concat(F.lit("line "), F.when(F.col("discard_id") % 500 == 120, "PHASE 4 starts").otherwise("text"))
    lines = table(spark, sf, "discards").select(F.col("discard_id").alias("pos"), line.alias("line"))
    return build.lines_from_marker(lines, "pos", "line", "PHASE 4").select("pos").distinct()


@query(f"""with {CHAINS}, p as (select row_number() over (order by k, a, b, chain) - 1 as pos, k from chains) select k, count(*) as n from p where pos >= 183 group by k""")
def post_index_slice(spark, sf):
    """Rows from position 183 on; the position is given by an order over all columns."""
    from loomstone.operators.sampling import running_before

    rows = chains(spark, sf).select("k", ((F.col("k") * 1_000 + F.col("a")) * 1_000 + F.col("b")).alias("place"))
    return running_before(rows, "place", tie="k").where("before >= 183").groupBy("k").agg(F.count("*").alias("n"))


@query("""select outcome, trip_id from (select outcome, trip_id, row_number() over (partition by outcome order by trip_id) as r from (select distinct trip_id, outcome from round_trip)) where (outcome = 'ANSWER_MISMATCH' and r <= 3) or (outcome = 'PARSE_INVALID' and r <= 2)""")
def first_k_by_category(spark, sf):
    rows = table(spark, sf, "round_trip").select("trip_id", "outcome").distinct()
    take = lambda kind, k: rows.where(F.col("outcome") == kind).orderBy("trip_id").limit(k)
    return take("ANSWER_MISMATCH", 3).union(take("PARSE_INVALID", 2)).select("outcome", "trip_id")


@query("""select corpus_id, round(words, 4) as ratio from (select corpus_id, compression_ratio as words from corpus where compression_ratio is not null) order by words desc, corpus_id limit 50""")
def worst_ratios(spark, sf):
    rows = table(spark, sf, "corpus").where("compression_ratio is not null").orderBy(F.desc("compression_ratio"), "corpus_id").limit(50)
    return rows.select("corpus_id", F.round("compression_ratio", 4).alias("ratio"))


@query("select not bool_or(isnan(ratio)) as passed, count(*) as n from (select compression_ratio as ratio from corpus where split = 'train' and compression_ratio is not null order by corpus_id limit 50)")
def gate_subset(spark, sf):
    first = table(spark, sf, "corpus").where("split = 'train' and compression_ratio is not null").orderBy("corpus_id").limit(50)
    return first.agg((~F.bool_or(F.isnan("compression_ratio"))).alias("passed"), F.count("*").alias("n"))


@query()
def decompose_translate_stub(spark, sf):
    """The whole build over new examples with the stand-in model: decompose, translate, repair, validate, assemble, filter."""
    from loomstone.plans.build import build_corpus
    from loomstone.sources.external import stand_in

    return build_corpus(table(spark, sf, "cot_examples"), table(spark, sf, "signatures"), stand_in).groupBy("reason").agg(F.count("*").alias("n"))
