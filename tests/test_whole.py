"""Queries over whole tables beside plain Python: on the test tables, and on small tables made of edge cases."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run(spark, name, folder):
    return entry.queries()[name](spark, str(folder)).collect()


def cleaned(chain):
    return re.sub(r"#([A-Z][A-Z0-9_]*)", lambda m: "#" + m.group(1).lower(), chain.strip())


def test_candidate_cleanup_edges(spark, tmp_path):
    from loomstone.plans.chain_queries import candidates

    chains = ["\t(F #x)\u3000", "(F #ABC_1 é)", "(F #ab_1 #aB #1)", "\n\n", "", "#", "(ADD #x 1) ; ü #Y", "(F #x)", "\u2003(F #LONG_NAME)\r\n", None, "(G #x #y) #", "#a##b"]
    spark.createDataFrame([(i, c) for i, c in enumerate(chains)], "corpus_id bigint, neuralese_chain string").write.parquet(f"{tmp_path}/corpus.parquet")
    got = {r.corpus_id: r.chain for r in run(spark, "candidate_cleanup", tmp_path)}
    assert got == {i: cleaned(c if i % 2 else re.sub("#([a-z][a-z0-9_]*)", lambda m: m.group().upper(), c)) for i, c in enumerate(chains) if c is not None}
    raw = {r.corpus_id: r.raw for r in candidates(spark, str(tmp_path)).collect()}
    assert raw[2] == "```lisp\n(F #AB_1 #AB #1)\n```" and raw[7] == "```lisp\n(F #x)\n```"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_candidate_cleanup_takes_all_chains(spark):
    rows = spark.read.parquet(f"{SF}/corpus.parquet").where("neuralese_chain is not null").select("corpus_id", "neuralese_chain").collect()
    got = {r.corpus_id: r.chain for r in run(spark, "candidate_cleanup", SF)}
    assert got == {r.corpus_id: cleaned(r.neuralese_chain) for r in rows}


def test_windows_and_pairs_of_documents(spark, tmp_path):
    texts = ["", "?!", None, "one", "a b c d e f g h", "élan vital_2; x-y\n" * 3, " ".join(f"w{i}" for i in range(300))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: re.findall(r"\w+", t or "") for i, t in enumerate(texts)}
    windows = {(r.doc_id, r.pos): (r.token, r.context) for r in run(spark, "context_window", tmp_path)}
    assert windows == {(i, p): (w[p], " ".join(w[max(p - 5, 0) : p + 6])) for i, w in words.items() for p in range(len(w))}
    pairs = {r.doc_id: r.pairs for r in run(spark, "band_join_pairs", tmp_path)}
    assert pairs == {i: sum(abs(a - b) <= 5 for a in range(len(w)) for b in range(len(w))) for i, w in words.items() if w}


def test_pairs_of_documents_are_made_without_a_join(spark, tmp_path):
    """Tokens are many times their table, by whose size a join would take them for small and broadcast them."""
    rows = [(1, "a b c d e f g h"), (1, "a b"), (1, "a b"), (2, " ".join("x" * 3000)), (None, "one two"), (None, "?"), (3, "-"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = entry.queries()["band_join_pairs"](spark, str(tmp_path))
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Broadcast" not in text
    sums = {}
    for i, t in rows:
        if n := len(re.findall(r"\w+", t or "")):
            sums[i] = sums.get(i, 0) + sum(abs(a - b) <= 5 for a in range(n) for b in range(max(a - 9, 0), min(a + 10, n)))
    assert {r.doc_id: r.pairs for r in made.collect()} == sums


def test_a_band_join_is_not_broadcast(spark):
    from loomstone.operators import corpus as build

    made = build.band_join(spark.range(40).selectExpr("id % 2 as g", "id as p"), "g", "p", 5)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.p, r.other) for r in made.collect()} == {(a, b) for a in range(40) for b in range(40) if (a - b) % 2 == 0 and abs(a - b) <= 5}


def test_boxed_of_all_rows(spark, tmp_path):
    rows = [(1, "q", "5"), (2, "q", ""), (3, "q", "}"), (4, "q", "a}b"), (5, "q", r"\\frac{1}{2}"), (6, "q" * 60, None), (7, None, None), (8, "q", "two\nlines")]
    spark.createDataFrame(rows, "corpus_id bigint, question string, answer string").write.parquet(f"{tmp_path}/corpus.parquet")

    def gold(question, answer):
        said = question if answer is None else r"\boxed{0} then \boxed{" + answer + "}"
        return said and (re.findall(r"\\boxed\{([^}]+)\}", said) or [said[:50]])[-1]

    assert {r.corpus_id: r.gold for r in run(spark, "boxed", tmp_path)} == {i: gold(q, a) for i, q, a in rows}
    assert gold("q", "") == "0" and gold("q", "a}b") == "a"


def size(chain):
    from loomstone.functions.chain import ChainError, read_nodes

    try:
        return len(read_nodes(chain or ""))
    except ChainError:
        return 0


def test_sql_surface_edges(spark, tmp_path):
    from loomstone.functions.chain import repair

    chains = ["(ADD 1 2)", "ADD 1 2", "", None, "(ADD 1", "plain words", "(ADD 1 2) (ADD 3 4)", "ADD 1 2", "[(F A) {B | 0.5}] ; end"]
    spark.createDataFrame(list(enumerate(chains)), "corpus_id bigint, neuralese_chain string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([(1, "ADD", 2, [], "R")], "pos int, symbol string, arity int, domain_types array<string>, range_type string").write.parquet(f"{tmp_path}/signatures.parquet")
    got = {r.corpus_id: (r.repaired, r.nodes, r.repaired_nodes) for r in run(spark, "sql_surface_all", tmp_path)}
    fixed = [None if c is None else repair(c) for c in chains]
    assert got == {i: (f, size(c), size(f)) for i, (c, f) in enumerate(zip(chains, fixed, strict=True))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_surface_reads_what_corpus_nodes_reads(spark):
    got = run(spark, "sql_surface_all", SF)
    assert len(got) == spark.read.parquet(f"{SF}/corpus.parquet").count()
    assert sum(r.nodes for r in got) == sum(r.n for r in run(spark, "corpus_nodes", SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_mix_over_the_scarcest_source_bisects(spark):
    rows = run(spark, "p9_mix_repeats", SF)
    most = {r.source: r.max_repeats for r in spark.read.parquet(f"{SF}/source_weights.parquet").collect()}
    assert rows and all(0 < r.exponent < 1 for r in rows) and all(r["pass"] <= most[r.source] for r in rows)
    assert sum(r.tokens for r in rows) > sum(r.tokens for r in run(spark, "p9_mix", SF))
