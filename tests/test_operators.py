"""Sampling, registries, joins of the build, files, streams and the external model."""

import json

import pytest
from pyspark.sql import functions as F

from loomstone.operators import corpus as build
from loomstone.operators import evaluation, registry, sampling
from loomstone.plans.build import build_corpus
from loomstone.sources import external, jsonl, readers
from loomstone.streaming import ingest


def test_smallest_keys_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ROWS_A_BUCKET", 7)
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise((F.col("id") % 2).cast("int")).alias("g"), (F.col("id") % 5).alias("w"))
    quotas = spark.createDataFrame([(0, 11), (1, 500), (None, 9)], "g int, q int")
    key = sampling.random_key(1, F.col("id"))
    rows = df.withColumn("k", key).collect()
    for weight in (None, "w"):
        got = {r.id for r in sampling.smallest_keys(df, ["g"], "id", key, quotas, "q", weight).collect()}
        want = set()
        for g, q in ((0, 11), (1, 500), (None, 9)):
            taken = 0
            for r in sorted((r for r in rows if r.g == g), key=lambda r: (r.k, r.id)):
                if taken >= q:
                    break
                want.add(r.id)
                taken += r.w if weight else 1
        assert got == want


def test_running_before(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ROWS_A_BUCKET", 5)
    df = spark.createDataFrame([(i * i, i % 3) for i in range(40)], "o bigint, a int")
    got = {r.o: r.before for r in sampling.running_before(df, "o", "a").collect()}
    total = 0
    for i in range(40):
        assert got[i * i] == total
        total += i % 3
    assert [r.batch for r in sampling.batches(df, "o", 15).orderBy("o").collect()] == [i // 15 for i in range(40)]
    kept = {r.o for r in sampling.cap_at_group_end(df, "o", "a", 4).collect()}
    assert kept == {o for o, b in got.items() if b < 4}
    assert sampling.running_before(df.limit(0), "o").count() == 0


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["easy"] * 25 + ["medium"] * 3 + ["hard"] * 50 + [None] * 2)], "i int, d string")
    out = sampling.stratified_split(df, "i", "d").groupBy("d", "split").count().collect()
    assert {(r.d, r.split): r["count"] for r in out} == {("easy", "test"): 2, ("easy", "train"): 23, ("medium", "test"): 1, ("medium", "train"): 2, ("hard", "test"): 40, ("hard", "train"): 10, (None, "train"): 2}


def test_registry(spark):
    have = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", None, 2)], "symbol string, arity int, pos int")
    assert {(r.symbol, r.arity) for r in registry.last_wins(have, ["symbol"], "pos").collect()} == {("a", 2), ("b", None)}
    new = spark.createDataFrame([("a", "x"), ("c", "y")], "symbol string, note string")
    assert {tuple(r) for r in registry.insert_if_absent(have.drop("pos"), new, "symbol").collect()} == {("a", 1, None), ("a", 2, None), ("b", None, None), ("c", None, "y")}
    paths = spark.createDataFrame([("ARITH_ADD", "Entity", ["Entity"]), ("q", "Process", None), ("r", "Entity", ["Entity", "Made"]), ("s", "Entity", ["Odd", "Made"]), ("t", "Modal", ["Modal", "Deontic"])], "symbol string, kind string, path array<string>")
    got = {r[0]: r[1] for r in paths.select("symbol", registry.normalise_type_path(F.col("symbol"), F.col("kind"), F.col("path"))).collect()}
    assert got == {"ARITH_ADD": ["Numeric", "NumericProperty"], "q": ["Process"], "r": ["Entity", "ConcreteEntity"], "s": ["Odd", "Made"], "t": ["Modal", "Deontic"]}
    assert [tuple(r) for r in registry.unknown_path_nodes(paths, "path").orderBy("node").collect()] == [("Made", 2), ("Odd", 1)]
    ids = registry.next_ids(spark.createDataFrame([("P0007",), (None,), ("x",)], "prim_id string"), spark.createDataFrame([("n",), ("m",)], "symbol string"), "prim_id", "symbol")
    assert {(r.symbol, r.prim_id) for r in ids.collect()} == {("m", "P0008"), ("n", "P0009")}


def test_joins(spark):
    tokens = spark.createDataFrame([("s", p, f"t{p}") for p in (0, 1, 4, 9, 20)], "s string, p int, t string")
    got = {(r.p, r.other) for r in build.band_join(tokens, "s", "p", 5).collect()}
    assert got == {(a, b) for a in (0, 1, 4, 9, 20) for b in (0, 1, 4, 9, 20) if abs(a - b) <= 5}
    assert {r.p: r.context for r in build.context_windows(tokens, "s", "p", "t", 5).collect()}[4] == "t0 t1 t4 t9"
    left = build.not_yet_done(spark.createDataFrame([(" a ",), ("a",), ("b",), (None,), (" c",)], "q string"), spark.createDataFrame([("b\n",), (None,)], "q string"), "q")
    assert sorted(r.q.strip() for r in left.collect()) == ["a", "c"]


def test_candidates(spark):
    prims = spark.createDataFrame([("ARITH_ADD", "adds"), ("SHOP", "a place to buy figs"), ("FIGS", "fruit"), ("TREE", None)], "symbol string, gloss string")
    steps = spark.createDataFrame([(1, "Buy figs at the shop"), (2, None)], "i int, s string")
    got = [(r.i, r.symbol, r.overlap, r["rank"]) for r in build.step_candidates(steps, "i", "s", prims, 10).orderBy("rank").collect()]
    assert got == [(1, "SHOP", 3, 1), (1, "FIGS", 1, 2)]
    assert [r.symbol for r in build.always_included(prims).collect()] == ["ARITH_ADD"]


def test_evaluation(spark):
    rows = spark.createDataFrame([("d", "A", True, 10), ("d", "B", False, 6), ("d", "B", None, 4), ("e", "A", True, 0), ("e", "B", True, 3)], "dataset string, condition string, correct boolean, reasoning_tokens int").withColumn("parse_valid", F.lit(True))
    assert {tuple(r) for r in evaluation.inference_compression(rows).collect()} == {("d", 10.0, 5.0, 0.5), ("e", 0.0, 3.0, None)}
    got = {(r.dataset, r.condition): r.accuracy for r in evaluation.metrics(rows, ["dataset", "condition"]).collect()}
    assert got[("d", "B")] == 0.0 and got[("d", "A")] == 1.0


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert sorted(r.a for r in jsonl.read_strict(spark, str(good), "a int").collect()) == [1, 2]
    assert sorted(r.a for r in jsonl.read_lenient(spark, str(bad), "a int").collect()) == [1, 3]
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(bad), "a int").collect()
    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    assert not jsonl.write_if_any(df, "i > 5", str(tmp_path / "none"))
    assert jsonl.write_if_any(df, "i = 1", str(tmp_path / "clean"))
    assert [tuple(r) for r in spark.read.schema("i int, s string").json(str(tmp_path / "clean")).collect()] == [(2, "y")]
    jsonl.write_document(df.limit(1), str(tmp_path / "doc"))
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "doc")).collect())) == {"i": 1, "s": "x"}
    rows = jsonl.lines_to_rows(spark.createDataFrame([(1, '{"a": 5}'), (2, '{"a": '), (3, None), (4, "")], "i int, raw string"), "raw", "a int", ["i"])
    assert [r.i for r in rows.where("readable").collect()] == [1]


def test_readers(spark):
    df = spark.createDataFrame([("q", "work #### 4"), ("r", "only work")], "q string, a string")
    assert [tuple(r) for r in readers.marked_answers(df, "q", "a").collect()] == [("q", "work", "4"), ("r", "only work", "")]
    arc = spark.createDataFrame([("q", ["A", "B"], ["x", "y"], "B"), ("q", ["A", "B"], ["x", "y"], "Z")], "q string, l array<string>, t array<string>, k string")
    assert [r.answer for r in readers.choices(arc, "q", "l", "t", "k").collect()] == ["y", "x"]


def test_streams(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = spark.createDataFrame([(1,), (2,)], "k int")
    df.write.parquet(src)
    assert ingest.ingest_once(spark, src, df.schema, out, cp).count() == 2
    df.write.mode("append").parquet(src)
    assert ingest.ingest_once(spark, src, df.schema, out, cp).count() == 4
    out2, cp2 = str(tmp_path / "out2"), str(tmp_path / "cp2")
    assert ingest.ingest_new_keys(spark, src, df.schema, out2, cp2, "k").count() == 2
    spark.createDataFrame([(2,), (3,)], "k int").write.mode("append").parquet(src)
    assert sorted(r.k for r in ingest.ingest_new_keys(spark, src, df.schema, out2, cp2, "k").collect()) == [1, 2, 3]


def test_progress(spark, tmp_path):
    import time

    from loomstone.streaming.progress import watch

    seen = watch(spark)
    df = spark.range(7)
    df.write.parquet(str(tmp_path / "s"))
    ingest.ingest_once(spark, str(tmp_path / "s"), df.schema, str(tmp_path / "t"), str(tmp_path / "c"))
    for _ in range(50):
        if sum(seen.rows.values()) == 7:
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    (key,) = [k for k, n in seen.rows.items() if n == 7]
    assert seen.rate(key) > 0 and seen.eta(key, 70) > 0 and seen.eta("none", 1) is None


def test_marker(spark):
    df = spark.createDataFrame([(1, "a"), (2, "MARK"), (3, "b"), (4, "MARK")], "p int, l string")
    assert sorted(r.p for r in build.lines_from_marker(df, "p", "l", "MARK").collect()) == [2, 3, 4]
    assert build.lines_from_marker(df, "p", "l", "NONE").count() == 0


def test_translation_retries(spark):
    from loomstone.functions.chain import Signature
    from loomstone.plans.build import translate_steps

    def make():
        def model(prompt):
            if "fail" in prompt:
                raise OSError("down")
            return "```\nADD 1 #X\n```" if "wrong" in prompt and "never" not in prompt else "(ADD 1)"

        return model

    df = spark.createDataFrame([(1, "step"), (2, "never"), (3, "fail"), (4, None)], "i int, s string")
    got = {r.i: (r.chain, r.attempts, r.err_kind) for r in translate_steps(df, "s", {"ADD": Signature(2)}, make).collect()}
    assert got == {1: ("(ADD 1 #x)", 2, None), 2: ("(ADD 1)", 3, "ARITY_MISMATCH"), 3: (None, 3, "PARSE_ERROR"), 4: (None, 0, "PARSE_ERROR")}


def test_external():
    said = iter(["not json", '{"items": [1, 2]}'])
    assert external.ask_json(lambda p: next(said), "p") == [1, 2]
    assert external.ask_json(lambda p: "no", "p") is None


def test_build(spark):
    examples = spark.createDataFrame([(1, "q", "First 3 plus 4 is here in this long sentence of many words so it is kept. " * 4, "7", "s"), (2, "q", None, "1", "s"), (3, "q", "Only 1 and 2.", "3", "s")], "example_id int, question string, cot string, answer string, source string")
    sigs = spark.createDataFrame([(1, "ARITH_EQUALS", 2, None, None)], "pos int, symbol string, arity int, domain_types array<string>, range_type string")
    got = {r.example_id: r for r in build_corpus(examples, sigs, external.stand_in).collect()}
    assert got[1].reason is None and got[1].step_count == 4 and got[1].chain.startswith("[(ARITH_EQUALS 3 4)")
    assert got[2].reason == "NO_STEPS" and got[3].reason is None or got[3].reason.startswith("COMPRESSION")


def test_models(spark):
    from loomstone.plans import mining

    near = spark.createDataFrame([(1, r, f"t{r % 12}") for r in range(1, 21)] + [(2, 1, "only")], "cluster_id int, rank int, token string")
    got = {r.prim_id: r for r in mining.label_clusters(near, mining.rule_model).collect()}
    assert set(got) == {"P0001"} and got["P0001"].example_tokens == [f"t{i}" for i in range(1, 11)] and got["P0001"].symbol == "T1_T2"
    prims = spark.createDataFrame([("KNOWN_TRUE", "Logical", "x"), ("LOGICAL_NOT", "Logical", None), ("CAT", "Entity", None), (None, "Entity", None)], "symbol string, prim_type string, gloss string")
    paths = {r.symbol: (r.type_path, r.reclassified) for r in mining.structure_types(prims, mining.rule_model).collect()}
    assert paths["KNOWN_TRUE"] == (["Modal"], True) and paths["LOGICAL_NOT"] == (["Logical", "Quantifier"], False)
    sigs = spark.createDataFrame([("OLD", 3, None, "R")], "symbol string, arity int, domain_types array<string>, range_type string")
    out = {r.symbol: r.arity for r in mining.write_signatures(prims, sigs, mining.rule_model).collect()}
    assert out == {"OLD": 3, "KNOWN_TRUE": 1, "LOGICAL_NOT": 2}


def test_matrix(spark, tmp_path):
    import numpy as np

    from loomstone.sources import matrix

    m = np.arange(60, dtype=np.float16).reshape(20, 3)
    np.save(tmp_path / "m.npy", m)
    rows = {r.vec_id: list(r.embedding) for r in matrix.read_matrix(spark, str(tmp_path / "m.npy"), 7).collect()}
    assert rows == {i: [float(x) for x in m[i]] for i in range(20)}
    from loomstone.sources.datasource import register_sources

    register_sources(spark)
    again = spark.read.format("npy").option("rowsPerPartition", "6").load(str(tmp_path / "m.npy"))
    assert {r.vec_id: list(r.embedding) for r in again.collect()} == rows and again.rdd.getNumPartitions() == 4
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "i int, t string")
    got = matrix.embed_rows(texts, "i", "t", lambda: lambda ts: [[len(t), 1.0] for t in ts], 2).collect()
    assert [(r.i, list(r.embedding)) for r in got] == [(1, [2.0, 1.0])]


def test_sql_functions(spark):
    from loomstone.functions.register import register

    sigs = spark.createDataFrame([(1, "F", 1, ["Entity"], "R")], "pos int, symbol string, arity int, domain_types array<string>, range_type string")
    register(spark, sigs)
    r = spark.sql("select validate('(F 1)').ok as a, validate_strict('(F 1)').err_kind as b, auto_repair('FX 1') as c, assemble_chain(array('x', 'y')) as d, extract_block('<answer> 4 </answer>', 'answer') as e, cosine(array(1f, 0f), array(1f, 0f)) as f").first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, "TYPE_ERROR", "(FX 1)", "[x y]", "4") and abs(r.f - 1) < 1e-6
    assert [x.expr for x in spark.sql("select expr from top_level_exprs('(A) BB 1') order by pos").collect()] == ["(A)", "BB 1"]
    assert spark.sql("select count(*) as n from parse_nodes('(F [A B])')").first().n == 4


def test_prompts(spark):
    """Prompts name what every prompt holds, then what is closest to the step; a model splits the reasoning, or gives none."""
    from loomstone.operators.corpus import prompt_symbols, run_statistics
    from loomstone.plans.build import decompose

    prims = spark.createDataFrame([("ARITH_ADD", "adds"), ("CAT_SAT", "the cat sat"), ("DOG", "a dog ran"), ("THEREFORE", None), (None, "cat")], "symbol string, gloss string")
    steps = spark.createDataFrame([(1, "The cat sat down"), (2, "nothing known")], "i bigint, s string")
    got = {r.i: r.symbols for r in prompt_symbols(steps, "i", "s", prims).collect()}
    assert got == {1: ["ARITH_ADD", "THEREFORE", "CAT_SAT"], 2: ["ARITH_ADD", "THEREFORE"]}
    assert {r.i: len(r.symbols) for r in prompt_symbols(steps, "i", "s", prims, 1).collect()} == {1: 1, 2: 1}

    def make():
        return lambda prompt: '["a", " ", "b"]' if "cat" in prompt else "[]" if "dog" in prompt else "no JSON"

    rows = spark.createDataFrame([(1, "the cat."), (2, "a dog."), (3, "One. Two."), (4, None)], "i bigint, cot string")
    split = {}
    for r in sorted(decompose(rows, "i", "cot", make).collect(), key=lambda r: (r.i, r.pos)):
        split.setdefault(r.i, []).append(r.step)
    assert split[1] == ["a", "b"] and 2 not in split and len(split[3]) == 2 and not any(split.get(4, []))
    stats = run_statistics(rows, spark.createDataFrame([(7,), (7,), (8,)], "d bigint"), "d").first()
    assert tuple(stats) == (6, 4, 2, 0.333333)
    assert run_statistics(rows.limit(0), rows.select("i").limit(0), "i").first().discard_rate == 1.0
