"""The chain language: reading, checking, repairing; random trees are rendered and read back."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import chain as lang
from loomstone.functions.chain import ChainError, Signature, read_nodes, repair, verdict

SIGS = {"ADD": Signature(2, ("Numeric", "Numeric"), "Numeric"), "SAME": Signature(2, ("Entity|Process", "Entity|Process"), "Relation"), "SO": Signature(1, ("Relation",), "Relation"), "ZERO": Signature(0)}


@pytest.mark.parametrize(
    "text",
    ["A", "12", "-3.5", "#x", "x_1", "(ADD 1 2)", "( ADD 1 2 )", "(ZERO)", "{(ADD 1 2)|0.85}", "{A | 1}", "{A | 0}", "{A | 1.00}", "[A B]", "[(ADD 1 2) [A B] #t]", "(λ x:Entity . (SO #x))", "(λx:Entity.x)", "(ADD 1;note\n2) ; end", "(ADD 3-4)", "(ADD xY)", "  (ADD # x 2)  "],
)
def test_reads(text):
    read_nodes(text)


@pytest.mark.parametrize("text", ["", " ", "()", "((A))", "(ADD 1 2", "(add 1)", "[A]", "[]", "{A}", "{A | 1.5}", "{A | -0.1}", "{A 0.5}", "{A | .5}", "(λ x . A)", "(λ x:entity . A)", "(λ X:Entity . A)", "A B", "(ADD 1 2))", "plain words here", "(λ x:Entity . A B)", "[A B", "{A | 0.5", "#", "# ;c", "(A]"])
def test_rejects(text):
    with pytest.raises(ChainError):
        read_nodes(text)


def test_deep_chain():
    n = 20_000
    nodes = read_nodes("(SO " * n + "A" + ")" * n)
    assert len(nodes) == n + 1 and nodes[-1].depth == n


def test_repair_of_deep_chain():
    n = 20_000
    assert repair("SO (SO " + "(SO " * n + "A" + ")" * n + ")") == "(SO (SO " + "(SO " * n + "A" + ")" * n + "))"
    assert repair("[" * n + "SO A" + "]" * n + " BE 1") == "[" + "[" * n + "(SO A)" + "]" * n + " (BE 1)]"


def trees(depth=3):
    atom = st.one_of(st.sampled_from(["A", "B_2", "ZED"]).map(lambda s: ("symbol", s)), st.integers(-99, 99).map(lambda n: ("number", str(n))), st.sampled_from(["x", "y1"]).map(lambda s: ("variable", s)))
    if depth == 0:
        return atom
    sub = trees(depth - 1)
    return st.one_of(
        atom,
        st.tuples(st.just("application"), st.sampled_from(["ADD", "SO", "ZERO"]), st.lists(sub, max_size=3)),
        st.tuples(st.just("sequence"), st.just(None), st.lists(sub, min_size=2, max_size=3)),
        st.tuples(st.just("assertion"), st.sampled_from(["0", "0.25", "1.0"]), st.lists(sub, min_size=1, max_size=1)),
        st.tuples(st.just("abstraction"), st.just("x:Entity"), st.lists(sub, min_size=1, max_size=1)),
    )


def render(t):
    kind = t[0]
    if len(t) == 2:
        return ("#" if kind == "variable" else "") + t[1]
    inner = " ".join(map(render, t[2]))
    return {"application": f"({t[1]} {inner})", "sequence": f"[{inner}]", "assertion": f"{{{inner} | {t[1]}}}", "abstraction": f"(λ {t[1]} . {inner})"}[kind]


def flatten(t, depth=0):
    yield t[0], depth, len(t[2]) if len(t) > 2 else 0
    for sub in t[2] if len(t) > 2 else ():
        yield from flatten(sub, depth + 1)


@settings(max_examples=200, deadline=None)
@given(trees())
def test_round_trip(t):
    assert [(n.kind, n.depth, len(n.args)) for n in read_nodes(render(t))] == list(flatten(t))


def test_first_error_is_the_deepest():
    assert verdict("(ADD (NOPE 1) 2 3)", SIGS)[1] == "UNKNOWN_SYMBOL"
    assert verdict("(NOPE (ADD 1))", SIGS)[2] == "ARITY_MISMATCH: ADD expects 2 args, got 1"
    assert verdict("[(NOPE) (ADD 1)]", SIGS)[2] == "UNKNOWN_SYMBOL: NOPE"
    assert verdict("(NOPE)", {}) == (True, None, None)
    assert verdict(None, SIGS)[1] == "PARSE_ERROR"


def test_strict_types():
    onto = {"CAT": ["Entity", "ConcreteEntity"], "RUN": ["Process"]}
    assert verdict("(SAME CAT RUN)", SIGS, onto)[0]
    assert verdict("(SAME CAT 3)", SIGS, onto)[2] == "TYPE_ERROR: SAME arg2 expects Entity|Process, got Numeric"
    assert verdict("(ADD (ADD 1 2) {3 | 0.5})", SIGS, onto)[0]
    assert verdict("(ADD #x UNKNOWN_THING)", SIGS, onto)[0]
    assert verdict("(SO [CAT RUN])", SIGS, onto)[1] == "TYPE_ERROR"


@pytest.mark.parametrize(
    ("text", "fixed"),
    [
        ("ADD 4 2", "(ADD 4 2)"),
        ("ADD 4 2 SAME #r 8", "[(ADD 4 2) (SAME #r 8)]"),
        ("(ADD 6 2) (SAME #t 12)", "[(ADD 6 2) (SAME #t 12)]"),
        ("(ADD 3 4)", "(ADD 3 4)"),
        ("(SAME CAT DOG) ADD 3 4", "[(SAME CAT DOG) (ADD 3 4)]"),
        ("ADD (ADD 3 4) 5", "(ADD (ADD 3 4) 5)"),
        ("[ADD 5 1 SAME 4]", "[(ADD 5 1) (SAME 4)]"),
        ("[[ADD 3 1 SAME 4] [ADD 3 4 SAME 9]]", "[[(ADD 3 1) (SAME 4)] [(ADD 3 4) (SAME 9)]]"),
        ("[(ADD 3 7) ADD 1 5]", "[(ADD 3 7) (ADD 1 5)]"),
        ("  ", ""),
        ("(ADD 1 2", "(ADD 1)"),
        ("[CAT (SO B)]", "[(CAT (SO B))]"),
        ("CAT", "(CAT)"),
        ("{ADD 1 | 0.5}", "{ADD 1 | 0.5}"),
        ("( ADD   1\n2 )", "(ADD 1 2)"),
    ],
)
def test_repair(text, fixed):
    assert repair(text) == fixed


def bracketed(depth=3):
    plain = st.one_of(st.integers(0, 99).map(str), st.sampled_from(["#x", "y1", "B"]))
    sub = st.one_of(plain, bracketed(depth - 1)) if depth else plain
    return st.tuples(st.sampled_from(["ADD", "SO", "ZERO"]), st.lists(sub, max_size=3)).map(lambda t: f"({' '.join([t[0], *t[1]])})")


@settings(max_examples=150, deadline=None)
@given(st.lists(bracketed(), min_size=1, max_size=4))
def test_repair_keeps_bracketed(members):
    """Chains whose members are all bracketed stay as they are, and several side by side become that sequence."""
    whole = members[0] if len(members) == 1 else f"[{' '.join(members)}]"
    assert repair(whole) == whole
    assert repair("\n".join(members)) == whole


def test_columns(spark):
    df = spark.createDataFrame([("(ADD 1 2)",), ("ADD 1 2",), (None,), ("",), ("(ADD 1)",)], "c string")
    v = df.select("c", lang.validator(SIGS)("c").alias("v"), lang.auto_repair("c").alias("r")).collect()
    assert [r.v.err_kind for r in v] == [None, "PARSE_ERROR", "PARSE_ERROR", "PARSE_ERROR", "ARITY_MISMATCH"]
    assert [r.r for r in v] == ["(ADD 1 2)", "(ADD 1 2)", None, "", "(ADD 1)"]
    nodes = df.select(F.explode(lang.parse_nodes("c")).alias("n")).select("n.*").collect()
    assert [(n.kind, n.parent_id, n.ord) for n in nodes if n.head is None][:2] == [("number", 0, 0), ("number", 0, 1)]
    tops = spark.createDataFrame([("(A) B 1 x",)], "c string").select(lang.top_level_exprs("c")).first()[0]
    assert tops == ["(A)", "B", "1", "x"]
    steps = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "s array<string>").select(lang.assemble(F.col("s")).alias("x")).collect()
    assert [r.x for r in steps] == ["[a [b c]]", "a", ""]
    marked = spark.createDataFrame([("(ADD FOO_BAR)", ["FOO_BAR"])], "c string, k array<string>").select(lang.highlight("c", "k")).first()[0]
    assert marked == "(ADD [!FOO_BAR!])"
    assert spark.createDataFrame([("(F #ABC #x)",)], "c string").select(lang.lower_variables("c")).first()[0] == "(F #abc #x)"


def test_signature_map(spark):
    df = spark.createDataFrame([(1, "F", 1, ["A"], "R"), (3, "F", 2, None, None), (None, "G", None, None, None), (2, None, 1, None, None)], "pos int, symbol string, arity int, domain_types array<string>, range_type string")
    assert lang.signature_map(df) == {"F": Signature(2), "G": Signature(0)}
