"""Mining and typing of symbols with a model handed in: naming clusters, sorting types, writing signatures."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import registry
from loomstone.operators.sampling import batches
from loomstone.sources.external import Model, ask_rows

LABEL = "symbol string, type string, gloss string, confidence double"


def label_clusters(nearest: DataFrame, make_model: Callable[[], Model], least: float = 0.6) -> DataFrame:
    """(prim_id, symbol, prim_type, gloss, confidence, example_tokens) of the clusters whose answer is a whole record of a known type.

    nearest has cluster_id, rank and token, the tokens next to each cluster's centre; the first ten distinct ones, by
    rank, are shown to the model and kept. Answers that aren't JSON, lack a field or are less sure than `least` are left out.
    """
    firsts = nearest.groupBy("cluster_id", "token").agg(F.min("rank").alias("rank"))
    tokens = firsts.groupBy("cluster_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda t: t["token"]), 1, 10).alias("example_tokens"))
    asked = tokens.withColumn("prompt", F.concat(F.lit("Name the concept of these tokens as JSON with symbol, type, gloss, confidence: "), F.to_json("example_tokens")))
    said = ask_rows(asked, "prompt", "raw", make_model).withColumn("r", F.from_json("raw", LABEL))
    good = F.col("r.symbol").isNotNull() & F.col("r.type").isin(*registry.HIERARCHY) & F.col("r.gloss").isNotNull() & (F.col("r.confidence") >= least)
    return said.where(good).select(F.format_string("P%04d", F.col("cluster_id")).alias("prim_id"), F.upper(F.replace("r.symbol", F.lit(" "), F.lit("_"))).alias("symbol"), F.col("r.type").alias("prim_type"), F.col("r.gloss").alias("gloss"), F.col("r.confidence").alias("confidence"), "example_tokens")


def structure_types(primitives: DataFrame, make_model: Callable[[], Model], size: int = 200) -> DataFrame:
    """primitives with type_path and reclassified: the model sorts each type's symbols into its subtypes, some hundred at a time.

    An answer is an array of objects with symbol, subtype and reclassify_to; unknown symbols are left out, of several
    answers for one the last given holds (of the last question by text), and symbols without one get the first subtype.
    """
    numbered = primitives.where("prim_type is not null and symbol is not null").withColumn("_b", F.pmod(F.xxhash64("symbol"), F.lit(1 << 20)) % F.lit(max(1, size)))
    asked = numbered.groupBy("prim_type", "_b").agg(F.to_json(F.sort_array(F.collect_set("symbol"))).alias("symbols")).select(F.concat(F.lit("Sort into subtypes, as a JSON array: "), "prim_type", F.lit(" "), "symbols").alias("prompt"))
    said = ask_rows(asked, "prompt", "raw", make_model)
    answer = said.select("prompt", F.posexplode(F.from_json("raw", "array<struct<symbol:string,subtype:string,reclassify_to:string>>")).alias("pos", "a")).select("prompt", "pos", "a.*")
    held = answer.where("symbol is not null").groupBy("symbol").agg(F.max_by(F.struct("subtype", "reclassify_to"), F.struct("prompt", "pos")).alias("a")).select("symbol", "a.*")
    joined = primitives.drop("type_path", "reclassified").join(held, "symbol", "left")
    path = registry.derive_type_path(F.col("prim_type"), F.col("subtype"), F.col("reclassify_to"))
    return joined.withColumn("type_path", path).withColumn("reclassified", F.col("reclassify_to").isNotNull()).drop("subtype", "reclassify_to")


def write_signatures(primitives: DataFrame, signatures: DataFrame, make_model: Callable[[], Model], size: int = 20) -> DataFrame:
    """(symbol, arity, domain_types, range_type): the signatures there are, the model's for signable symbols without one, asked for
    in batches of `size`, and the default for those it doesn't answer."""
    have = signatures.select("symbol", "arity", "domain_types", "range_type")
    todo = primitives.where(F.col("prim_type").isin(*registry.SIGNABLE) & F.col("symbol").isNotNull()).select("symbol", F.coalesce("gloss", F.lit("")).alias("gloss")).dropDuplicates(["symbol"]).join(have.select("symbol"), "symbol", "left_anti")
    cut = batches(todo.withColumn("_o", F.xxhash64("symbol")), "_o", size)
    asked = cut.groupBy("batch").agg(F.to_json(F.sort_array(F.collect_list(F.struct("symbol", "gloss")))).alias("s")).select(F.concat(F.lit("Write signatures as a JSON array: "), "s").alias("prompt"))
    said = ask_rows(asked, "prompt", "raw", make_model).select(F.explode(F.from_json("raw", "array<struct<symbol:string,arity:int,domain:array<string>,range:string>>")).alias("a"))
    new = said.select("a.symbol", "a.arity", F.col("a.domain").alias("domain_types"), F.col("a.range").alias("range_type")).where("symbol is not null and arity is not null").dropDuplicates(["symbol"]).join(todo.select("symbol"), "symbol", "left_semi")
    return registry.fill_signatures(have.unionByName(new), primitives)


def grammar_gaps(primitives: DataFrame, make_model: Callable[[], Model], most: int = 200) -> DataFrame:
    """(said): the model's text on what the language lacks for the first `most` symbols, by id. One prompt, by nature."""
    first = primitives.where("symbol is not null").orderBy(F.asc_nulls_last("prim_id"), "symbol").limit(most)
    lines = first.select(F.struct("prim_id", F.concat_ws(": ", "symbol", "gloss").alias("line")).alias("x")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("t"))
    return ask_rows(lines.select(F.concat(F.lit("What can't be said with these symbols?\n"), "t").alias("prompt")), "prompt", "said", make_model).select("said")


def rule_model() -> Model:
    """Answers the three prompts by rule, for tests and dry runs."""

    def answer(prompt: str) -> str:
        if prompt.startswith("Name"):
            tokens = json.loads(prompt[prompt.index("[") :])
            return json.dumps({"symbol": " ".join(map(str, tokens[:2])), "type": "Entity", "gloss": "from tokens", "confidence": 0.5 + 0.05 * len(tokens)})
        if prompt.startswith("Sort"):
            return json.dumps([{"symbol": s, "subtype": None, "reclassify_to": "Modal" if s.startswith("KNOWN") else None} for s in json.loads(prompt[prompt.index("[") :])])
        if prompt.startswith("What"):
            return f"{prompt.count(chr(10))} symbols shown"
        return json.dumps([{"symbol": r["symbol"], "arity": 1, "domain": ["Entity"], "range": "Relation"} for r in json.loads(prompt[prompt.index("[") :]) if "NOT" not in r["symbol"]])

    return answer
