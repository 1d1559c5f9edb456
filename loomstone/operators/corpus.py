"""Building and auditing the corpus: quality filter, step matching, round trip, joins of the build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.functions import answers, text
from loomstone.functions.vectors import top_k_per_group

# Symbols that every prompt holds, by prefix.
ALWAYS_PREFIXES = (
    "ARITH_",
    "CAUSAL_",
    "LOGICAL_",
    "TEMPORAL_",
    "IS_INSTANCE_OF",
    "IS_PART_OF",
    "IS_EQUIVALENT_TO",
    "IS_GREATER_THAN",
    "IS_LESS_THAN",
    "THEREFORE",
    "BECAUSE",
    "FORALL",
    "EXISTS",
    "KNOWN_TRUE",
    "BELIEVED_TRUE",
    "UNCERTAIN",
)


MOST_SYMBOLS = 1_000_000


def _always(symbol: Column) -> Column:
    return symbol.rlike("^(" + "|".join(ALWAYS_PREFIXES) + ")")


def discard_reason(chain_words: Column, cot_words: Column, no_steps: Column | None = None, step_error: Column | None = None, chain_error: Column | None = None) -> Column:
    """Why a translated row is discarded, null where it is kept; the first that holds of NO_STEPS, STEP_PARSE_FAIL,
    CHAIN_PARSE_FAIL, COMPRESSION_HIGH (ratio above 1.5) and COMPRESSION_SHORT (under 25 words and ratio above 1)."""
    ratio = chain_words / F.greatest(cot_words, F.lit(1))
    shown = F.format_string("%.3f", ratio)
    parts = []
    if no_steps is not None:
        parts.append(F.when(no_steps, "NO_STEPS"))
    if step_error is not None:
        parts.append(F.when(step_error.isNotNull(), F.concat(F.lit("STEP_PARSE_FAIL:"), step_error)))
    if chain_error is not None:
        parts.append(F.when(chain_error.isNotNull(), F.concat(F.lit("CHAIN_PARSE_FAIL:"), chain_error)))
    parts.append(F.when(ratio > 1.5, F.concat(F.lit("COMPRESSION_HIGH:"), shown)))
    parts.append(F.when((cot_words < 25) & (ratio > 1.0), F.concat(F.lit("COMPRESSION_SHORT:"), shown)))
    return F.coalesce(*parts)


def step_candidates(steps: DataFrame, step_id: str, step: str, primitives: DataFrame, k: int = 10) -> DataFrame:
    """(step_id, symbol, overlap, rank): the k primitives that share most words with a step, ties by symbol.

    Words of gloss and symbol are exploded and joined with the words of the step, so there is no cross match. Primitives
    whose symbol every prompt holds are left out (see always_included).
    """
    words = steps.select(F.col(step_id), F.explode(text.word_set(F.col(step))).alias("w"))
    named = primitives.where(~_always(F.col("symbol")))
    terms = named.select("symbol", F.explode(F.array_union(text.word_set(F.coalesce("gloss", F.lit(""))), text.word_set(F.col("symbol")))).alias("w")).distinct()
    # registries are small beside the steps; one of up to a million symbols goes to every executor, so frequent words aren't gathered
    if primitives.limit(MOST_SYMBOLS + 1).count() <= MOST_SYMBOLS:
        terms = F.broadcast(terms)
    scored = words.join(terms, "w").groupBy(step_id, "symbol").agg(F.count("*").alias("overlap"))
    return top_k_per_group(scored, [step_id], "overlap", "symbol", k)


def always_included(primitives: DataFrame) -> DataFrame:
    return primitives.where(_always(F.col("symbol")))


def prompt_symbols(steps: DataFrame, step_id: str, step: str, primitives: DataFrame, most: int = 15) -> DataFrame:
    """(step_id, symbols): what a prompt names for each step: the symbols that every prompt holds, then its own candidates, `most` at most."""
    always = always_included(primitives.where("symbol is not null")).agg(F.array_sort(F.collect_set("symbol")).alias("always"))
    own = step_candidates(steps, step_id, step, primitives.where("symbol is not null")).groupBy(step_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("own"))
    both = steps.select(step_id).distinct().join(own, step_id, "left").crossJoin(F.broadcast(always))
    return both.select(step_id, F.slice(F.array_distinct(F.concat("always", F.coalesce("own", F.array().cast("array<string>")))), 1, most).alias("symbols"))


def run_statistics(kept: DataFrame, discarded: DataFrame, discard_id: str) -> DataFrame:
    """(total, success, discarded, discard_rate) of a build; a row logged twice counts once, and an empty build has a rate of 1."""
    lost = discarded.agg(F.countDistinct(discard_id).alias("discarded"))
    sums = kept.agg(F.count("*").alias("success")).crossJoin(F.broadcast(lost)).withColumn("total", F.col("success") + F.col("discarded"))
    return sums.select("total", "success", "discarded", F.when(F.col("total") > 0, F.round(F.col("discarded") / F.col("total"), 6)).otherwise(1.0).alias("discard_rate"))


def not_yet_done(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose trimmed key isn't in `done`, one for each key (the one that sorts first by all columns kept)."""
    trimmed = text.strip(F.col(key))
    left = new.withColumn("_k", trimmed).where("_k is not null").join(done.select(trimmed.alias("_k")).where("_k is not null").distinct(), "_k", "left_anti")
    return left.groupBy("_k").agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")


def context_windows(tokens: DataFrame, group: str, position: str, token: str, reach: int = 5) -> DataFrame:
    """(group, position, token, context): the tokens at most `reach` positions away, in order, joined by spaces.

    A range frame over the position, so gaps count as positions without a token.
    """
    frame = W.partitionBy(group).orderBy(position).rangeBetween(-reach, reach)
    return tokens.select(group, position, token, F.array_join(F.collect_list(token).over(frame), " ").alias("context"))


def band_join(tokens: DataFrame, group: str, position: str, reach: int = 5) -> DataFrame:
    """(group, position, other): positions of a group at most `reach` apart, by an equi join on buckets of positions.

    The sides are sorted and merged: rows that were exploded are far more than their estimate, by which a side could be broadcast.
    """
    a = tokens.select(F.col(group), F.col(position), F.explode(F.sequence(F.floor((F.col(position) - reach) / (reach + 1)), F.floor((F.col(position) + reach) / (reach + 1)))).alias("_b"))
    b = tokens.select(F.col(group), F.col(position).alias("other"), F.floor(F.col(position) / (reach + 1)).alias("_b"))
    return a.hint("merge").join(b.hint("merge"), [group, "_b"]).where(F.abs(F.col("other") - F.col(position)) <= reach).select(group, position, "other")


def band_within(rows: DataFrame, key: str, count: Column, position: str, reach: int = 5) -> DataFrame:
    """(key, position, other): positions of a row at most `reach` apart, where its positions are 0 to `count` - 1.

    Made inside each row, so nothing is joined, shuffled or broadcast; rows with the same key stay apart, and a key may be null.
    """
    at = rows.select(key, count.cast("bigint").alias("_n")).select(key, "_n", F.posexplode(F.array_repeat(F.lit(True), F.col("_n").cast("int"))).alias("_p", "_")).withColumn(position, F.col("_p").cast("bigint"))
    near = F.sequence(F.greatest(F.col(position) - reach, F.lit(0)), F.least(F.col(position) + reach, F.col("_n") - 1))
    return at.select(key, position, F.explode(near).alias("other"))


def lines_from_marker(lines: DataFrame, position: str, line: str, marker: str) -> DataFrame:
    """Lines from the first that holds the marker on; none where none does."""
    start = lines.where(F.col(line).contains(marker)).agg(F.min(position).alias("__start"))
    return lines.crossJoin(F.broadcast(start)).where(F.col(position) >= F.col("__start")).drop("__start")


def round_trip_outcome(parse_error: Column, response: Column, gold: Column, compat: bool = False) -> Column:
    """PARSE_INVALID, EVAL_FAIL (no response), ANSWER_MISMATCH or SURVIVOR; the response counts by its first number."""
    predicted = predicted_answer(response)
    return F.when(parse_error.isNotNull(), "PARSE_INVALID").when(response.isNull(), "EVAL_FAIL").when(answers.matches(predicted, gold, compat), "SURVIVOR").otherwise("ANSWER_MISMATCH")


def predicted_answer(response: Column) -> Column:
    return answers.let(answers.first_number(response), lambda n: F.when(n != "", n).otherwise(F.substring(response, 1, 50)))


def spot_flags(ok: Column, unknown: Column, ratio: Column, steps: Column, question: Column, answer: Column, chain: Column) -> Column:
    """Flags of the automatic spot check, OK where there is none."""
    literals = text.find_all(chain, text.NUMBER_LITERAL)
    n = answers.as_number(answer)
    spelled = F.array(answer, F.when((n == F.floor(n)) & (F.abs(n) < float(1 << 53)), n.cast("bigint").cast("string")).otherwise(answer))
    lost = n.isNotNull() & (F.size(literals) > 0) & ~F.arrays_overlap(literals, spelled)
    suspect = lost | (F.size(text.orphaned_variables(chain)) > 0) | text.underkill(question, steps)
    flags = F.array_compact(
        F.array(
            F.when(~ok, "GRAMMAR_INVALID"),
            F.when(unknown > 0, "HALLUC_PRIM"),
            F.when((ratio > 0.85) & (steps > 4), "CORRECT_VERBOSE"),
            F.when(F.coalesce(suspect, F.lit(False)), "SEMANTICALLY_SUSPECT"),
        )
    )
    return F.when(F.size(flags) == 0, F.array(F.lit("OK"))).otherwise(flags)
