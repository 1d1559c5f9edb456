"""The corpus build as one plan: steps, translation by a model handed in, repair, checks, assembly and the quality filter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import chain as lang
from loomstone.functions import text
from loomstone.operators import corpus as build
from loomstone.sources.external import Model, ask_rows


FENCE_OPEN, FENCE_CLOSE = re.compile(r"^```[a-z]*\n?"), re.compile(r"\n?```$")
NAMED = re.compile(r"#([A-Z][A-Z0-9_]*)")


def tidy(raw: str) -> str:
    """What a model wrote, as a chain: without a code fence, #NAMES in lower case, brackets repaired."""
    bare = FENCE_CLOSE.sub("", FENCE_OPEN.sub("", raw.strip())).strip()
    return lang.repair(NAMED.sub(lambda m: "#" + m.group(1).lower(), bare))


def decompose(rows: DataFrame, row_id: str, cot: str, make_model: Callable[[], Model] | None) -> DataFrame:
    """(row_id, pos, step): the steps of each reasoning. A model is asked for a JSON array of steps; where it gives none that can be read, or none is
    handed in, sentences are the steps. An empty array means no steps; blank reasoning isn't asked for."""
    sentences = text.sentence_steps(F.coalesce(F.col(cot), F.lit("")))
    if make_model is None:
        return rows.select(row_id, F.posexplode(sentences).alias("pos", "step"))
    asked = rows.withColumn("_prompt", F.when(F.trim(F.col(cot)) != "", F.concat(F.lit("Split into single steps, as a JSON array of strings: "), F.col(cot))))
    said = ask_rows(asked, "_prompt", "_raw", make_model)
    steps = F.coalesce(F.from_json("_raw", "array<string>"), sentences)
    return said.select(row_id, F.posexplode(F.filter(steps, lambda s: F.trim(s) != "")).alias("pos", "step"))


def translate_steps(steps: DataFrame, step: str, signatures: dict[str, lang.Signature], make_model: Callable[[], Model], tries: int = 3) -> DataFrame:
    """Adds chain, attempts and err_kind: each step is asked for until its chain is valid, `tries` times at most, the error of the last answer
    following the prompt. A model that fails counts as an answer that can't be parsed; a null step isn't asked for."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            out = []
            for s in pdf[step]:
                chain, kind, turn = None, lang.PARSE_ERROR, 0
                prompt = s
                while s is not None and kind is not None and turn < tries:
                    turn += 1
                    try:
                        chain = tidy(model(prompt))
                        _, kind, error = lang.verdict(chain, signatures)
                    except Exception as e:  # noqa: BLE001  a failing service is asked again
                        kind, error = lang.PARSE_ERROR, str(e)
                    prompt = f"{s}\nThe last answer was wrong: {error}"
                out.append((chain, turn, kind))
            done = pd.DataFrame(out, columns=["chain", "attempts", "err_kind"], index=pdf.index).astype({"chain": object, "err_kind": object})
            yield pd.concat([pdf, done], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema)
    return steps.mapInPandas(work, f"{fields}, chain string, attempts int, err_kind string")


def with_symbols(steps: DataFrame, primitives: DataFrame) -> DataFrame:
    """steps (example_id, pos, step) with `prompt`: the step, and the symbols a prompt names for it."""
    keyed = steps.withColumn("_s", F.concat_ws(":", "example_id", "pos"))
    named = build.prompt_symbols(keyed, "_s", "step", primitives)
    return keyed.join(named, "_s").withColumn("prompt", F.concat("step", F.lit("\nSymbols: "), F.array_join("symbols", ", "))).drop("_s", "symbols")


def build_corpus(examples: DataFrame, signatures: DataFrame, make_model: Callable[[], Model], tries: int = 3, primitives: DataFrame | None = None, make_splitter: Callable[[], Model] | None = None) -> DataFrame:
    """(example_id, question, chain, answer, compression_ratio, step_count, source, reason): reason is null for rows kept.

    Steps of a row are asked for separately and come together again by its id, in order. A row without steps (null or
    blank reasoning, or a model that splits it into none) is NO_STEPS. With primitives, prompts name the symbols that every prompt
    holds and those closest to the step. A step that can't be read or breaks a signature makes its row STEP_PARSE_FAIL.
    """
    rows = examples.where("example_id is not null").dropDuplicates(["example_id"]).select("example_id", "question", "cot", "answer", "source")
    steps = decompose(rows, "example_id", "cot", make_splitter)
    steps = steps.withColumn("prompt", F.col("step")) if primitives is None else with_symbols(steps, primitives)
    known = lang.signature_map(signatures)
    check = lang.validator(known)
    judged = translate_steps(steps, "prompt", known, make_model, tries).select("example_id", F.struct("pos", "chain", F.col("err_kind").alias("bad")).alias("s"))
    folded = judged.groupBy("example_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    chains = folded.select("example_id", F.transform("s", lambda x: x["chain"]).alias("steps"), F.get(F.filter(F.transform("s", lambda x: x["bad"]), lambda b: b.isNotNull()), F.lit(0)).alias("step_bad"))
    whole = rows.join(chains, "example_id", "left").withColumn("chain", lang.assemble(F.coalesce("steps", F.array().cast("array<string>"))))
    whole = whole.withColumn("v", F.when(F.col("steps").isNotNull(), check("chain")))
    words, cot_words = text.token_count(F.col("chain")), text.token_count(F.coalesce("cot", F.lit("")))
    reason = build.discard_reason(words, cot_words, F.col("steps").isNull(), F.col("step_bad"), F.col("v.err_kind"))
    return whole.select("example_id", "question", "chain", "answer", text.compression_ratio(words, cot_words).alias("compression_ratio"), F.coalesce(F.size("steps"), F.lit(0)).alias("step_count"), "source", reason.alias("reason"))
