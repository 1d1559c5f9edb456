"""Tokens, layouts, look-alikes, leaks, terms, defects and mixtures, against independent computations."""

import base64
import random
import unicodedata

import pytest
import tiktoken
from pyspark.sql import functions as F

from loomstone.llm import defects, layout, leaks, lookalike, mixture, terms, tokens

SAMPLES = ["", "Hello  world", "it's 1,234.5 λx.(F #y)\n\n\tend  ", "日本語のテキスト と emoji 🙂🙂", "a" * 3000, "naïve café — Größe", "Сколько стоит?", "x\r\n\r\ny"]


def test_tokens_equal_the_library():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = SAMPLES + ["".join(rng.choice("ab c'1é\n(") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    counter = tokens.Counter(tokens.MergeTable(tokens.VOCABULARY))
    assert counter.count([*texts, None]) == [len(enc.encode_ordinary(t)) for t in texts] + [None]
    assert [counter.count([t])[0] for t in texts[:20]] == [len(enc.encode_ordinary(t)) for t in texts[:20]]


def test_token_totals(spark):
    df = spark.createDataFrame([(1, "a b", "s", None), (2, None, "s", None), (3, "c", None, "en")], "i bigint, t string, source string, lang string")
    counts = tokens.token_counts(df, "i", {"n": "t"}, ["source", "lang"])
    got = {tuple(r) for r in tokens.token_totals(counts, ["source", "lang"], ["n"]).collect()}
    assert got == {("s", None, 2, 2), (None, "en", 1, 1)}


def word_list(t):
    return [w.lower() for w in "".join(ch if ch.isalnum() else " " for ch in t).split()]


def test_layout_hashes_follow_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB ,.é\n") for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    hashes, has = layout.layout_hashes(texts)
    by_words, by_hash = {}, {}
    for t, h, w in zip(texts, hashes.tolist(), has.tolist(), strict=True):
        words = tuple(word_list(t))
        assert w == bool(words)
        if words:
            assert by_words.setdefault(words, h) == h
            assert by_hash.setdefault(h, words) == words
    for _ in range(3000):
        a, b = rng.choice(texts), rng.choice(texts)
        assert layout.same_layout_free(a, b) == (word_list(a) == word_list(b))


def test_layout_long_powers():
    long = "ab " * 60_000
    hashes, _ = layout.layout_hashes([long, long.upper().replace(" ", "\n--"), long + "c"])
    assert hashes[0] == hashes[1] != hashes[2]


def test_layout_collisions_are_split(spark, monkeypatch):
    """When hashes collide, two pointers tell the rows apart and what differs is grouped again."""
    def weak(batches):
        for pdf in batches:
            yield pdf.assign(h1=1, h2=1)[["id", "h1", "h2"]]

    monkeypatch.setattr(layout, "_hash_batches", weak)
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "A!", "x"), (4, "b.", "X"), (5, "c", "x"), (6, "B", "x")], "i bigint, a string, b string")
    assert sorted(map(tuple, layout.layout_copies(df, "i", "a", "b").collect())) == [(1, 3), (2, 4), (2, 6)]


def test_read_lines(spark):
    lines = ['{"question": "q\\u00e9", "neuralese_chain": "c"}', '{"question": 5, "neuralese_chain": null}', '{"question": "q"', "", None, "[1]", ' {"neuralese_chain":"d","question":"x"} ']
    df = spark.createDataFrame(list(enumerate(lines)), "i bigint, raw string")
    got = {tuple(r) for r in layout.read_lines(df, "i", "raw", ["question", "neuralese_chain"]).collect()}
    assert got == {(0, "qé", "c"), (1, None, None), (6, "x", "d")}


def plain_form(text):
    pairs = {p[0]: p[1] for p in lookalike.LOOKALIKE_LETTERS.split()}
    out = []
    for ch in unicodedata.normalize("NFD", text):
        kind = unicodedata.category(ch)
        if kind == "Cf":
            continue
        if kind == "Zs":
            ch = " "
        elif ch in lookalike.HYPHENS:
            ch = "-"
        elif 0xFF01 <= ord(ch) <= 0xFF5E:
            ch = chr(ord(ch) - 0xFEE0)
        out.append(pairs.get(ch, ch))
    return unicodedata.normalize("NFC", "".join(out))


@pytest.mark.parametrize("used", [None, {"а": 9, "a": 3, "ё": 5, "ë": 2, "－": 4, "е": 10}])
def test_forms_agree_with_plain(used):
    rng = random.Random(4)
    alphabet = "aAeео ОоοéёйиСсCкЯ²2-‑－ＡａΆ̈​\xad\xa0　\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    rewrite = lookalike.Rewriter(used)
    seen, back = {}, {}
    for t in texts:
        mine, plain = rewrite(t), plain_form(t)
        assert seen.setdefault(plain, mine) == mine
        assert back.setdefault(mine, plain) == plain
        assert rewrite(mine) == mine


def test_form_keeps_what_is_seen():
    rewrite = lookalike.Rewriter()
    assert rewrite("Ｆｕｌｌ－ｗｉｄｔｈ") == "Full-width"
    assert rewrite("x²") == "x²" and rewrite("é") != rewrite("e") and rewrite("A") != rewrite("a") and rewrite("a\nb") != rewrite("a b")
    assert rewrite("e​́") == rewrite("é") and rewrite("а́") == rewrite("á")


def test_lookalike_pairs_skip_copies(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "аbc"), (4, "ab​c"), (5, "abd"), (6, "abc")], "i bigint, t string")
    assert {tuple(r) for r in lookalike.lookalike_pairs(df, "i", "t").collect()} == {(1, 3), (2, 3), (3, 6), (1, 4), (2, 4), (4, 6), (3, 4)}
    forms = {r.i: r.form for r in lookalike.canonical_forms(df, "i", "t").collect()}
    assert len({forms[i] for i in (1, 2, 3, 4, 6)}) == 1


def test_leaks_against_plain(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 20, 40])))) for i in range(60)]
    docs = []
    for d in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6:
            words = rng.choice(items)[1].split()
            a = rng.randrange(len(words))
            body[len(body) // 2 : len(body) // 2] = words[a : a + rng.randint(8, 20)]
        docs.append((d, ", ".join(body)))
    docs.append((999, " ".join(rng.choice(vocab) for _ in range(20_000)) + " " + items[3][1]))
    runs = {}
    for i, t in items:
        w = t.split()
        for j in range(len(w) - 11):
            runs.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [t.replace(",", "").split()] for j in range(len(w) - 11) for i in runs.get(tuple(w[j : j + 12]), ())}
    got = {tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", spark.createDataFrame(items, "i bigint, t string"), "i", "t").collect()}
    assert got == want and want


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PATTERNS_AT_ONCE", 20)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(14))) for i in range(9)]
    docs = [(100 + i, "so " + t + " end") for i, t in items]
    got = {tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", spark.createDataFrame(items, "i bigint, t string"), "i", "t").collect()}
    assert got == {(100 + i, i) for i in range(9)}


def test_documents_are_scanned_once_whatever_the_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leaks, "PATTERNS_AT_ONCE", 3)
    spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(9)], "i bigint, t string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = leaks.leaked_items(docs, "i", "t", docs, "i", "t")
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan parquet") == 1
    assert {tuple(r) for r in found.collect()} == {(i, i) for i in range(9)}


def test_hot_layout_class(spark, monkeypatch):
    """A class larger than a task should hold is cut; every copy is still found."""
    monkeypatch.setattr(layout, "HOT_CLASS", 4)
    df = spark.createDataFrame([(i, "A  b" if i % 3 else "a, B!", "(X 1)") for i in range(30)] + [(50 + i, "a b", f"(Y {i // 2})") for i in range(6)], "i bigint, a string, b string")
    want = {(0, i) for i in range(1, 30)} | {(50, 51), (52, 53), (54, 55)}
    assert {tuple(r) for r in layout.layout_copies(df, "i", "a", "b").collect()} == want
    assert {tuple(r) for r in layout.layout_groups(df, "i", "a", "b").collect()} == {(0, 30), (50, 2), (52, 2), (54, 2)}


def test_terms(spark):
    df = spark.createDataFrame([("(ADD a_1 add 1x _y) ; add",), ("(ADD é B)",), (None,), ("",)], "c string")
    got = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, terms.symbol_terms(F.col("c"))).collect()}
    assert got == {"ADD": (4, 2), "A_1": (1, 1), "B": (1, 1)}
    marks = {r.term: r.mark for r in terms.mark_terms(terms.term_frequencies(df, terms.symbol_terms(F.col("c"))), df, rare_records=1, common_share=0.4).collect()}
    assert marks == {"ADD": "common", "A_1": "rare", "B": "rare"}


Q = "A school in Dorm ordered 12 figs. How many figs remain in Dorm on Monday?"
CASES = [
    (Q, "(ADD 1 2)", "12", None),
    (Q, "(ADD 1 2)", "No, Ann cannot carry all 12 figs to Dorm.", None),
    (Q, "(ADD 1 2) ; see (3\n", "none left", None),
    (Q, None, "12", "empty"),
    (Q, "{ }", "12", "empty"),
    (Q, "(ADD 1 2)", "N/A", "empty"),
    (Q, "(ADD 1 2)", "​", "empty"),
    (Q, "[(ADD 1 2) (ADD", "12", "truncated"),
    (Q, "(ADD 1 2)", "Ann has 12 figs left after the", "truncated"),
    (Q, "I'm sorry, but I can't help with this.", "12", "refusal"),
    (Q, "(ADD 1 2)", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
    (Q, Q.upper(), "12", "copy"),
    (Q, "(ADD 1 2)", "how many figs remain, in Dorm on Monday", "copy"),
    (Q, "(ADD 1 2)", "Il reste 12 figues à Ann après le voyage à Dorm.", "language"),
    (Q, "(ADD 1 2)", "После поездки у Ann осталось 12 штук, а не 7.", "language"),
    (None, "(ADD 1 2)", "Il reste 12 figues à Ann après le voyage.", None),
]


def test_defects(spark):
    df = spark.createDataFrame([(i, q, c, a) for i, (q, c, a, _) in enumerate(CASES)], "i bigint, q string, c string, a string")
    got = {r.i: r.defect for r in defects.defective_pairs(df, "i", "q", "c", "a").collect()}
    assert got == {i: d for i, (*_, d) in enumerate(CASES) if d}


SCHOOL = "How many apples are left for the children of the school?"
# Phrases and languages in no list of the operator, or content that only sounds like a defect.
HELD_OUT = [
    (SCHOOL, "He said: I am sorry.", None),
    (SCHOOL, "I cannot be divided by two, said seven.", None),
    (SCHOOL, "The answer is 12. I cannot stress this request enough, it took a while.", None),
    (SCHOOL, "The Eiffel Tower", None),
    (SCHOOL, "Gustave Eiffel built it", None),
    (SCHOOL, "red apples of the north", None),
    (SCHOOL, "Ann has 12 apples left for the", "truncated"),
    (SCHOOL, "There are twelve apples left because Bob ate", "truncated"),
    (SCHOOL, "Dopo la gita rimangono ancora trenta mele per i bambini della scuola.", "language"),
    (SCHOOL, "Depois da viagem ainda há trinta maçãs para as crianças da escola.", "language"),
    (SCHOOL, "学校的孩子们还剩下三十个苹果。", "language"),
    (SCHOOL, "Az iskola gyerekeinek végül harminc alma maradt meg délutánra összesen.", "language"),
    (SCHOOL, "Koulun lapsille jäi lopulta kolmekymmentä omenaa iltapäivän välipalaa varten tänään.", "language"),
    (SCHOOL, "Desculpe, não posso responder a esta pergunta.", "refusal"),
    (SCHOOL, "Mi dispiace, ma non sono in grado di rispondere.", "refusal"),
    (SCHOOL, "Sorry, we are unable to help with homework.", "refusal"),
    (SCHOOL, "Thirty apples, Dahuli counted them twice on Tuesday.", None),
]


@pytest.mark.parametrize(("question", "answer", "want"), HELD_OUT)
def test_defects_held_out(question, answer, want):
    assert defects.defect_of(question, "(ADD 1 2)", answer) == want


def test_suffix_automaton_runs():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(2)]
        whole = "".join(a)
        want = [max(n for n in range(i + 2) if "".join(b[i + 1 - n : i + 1]) in whole) for i in range(len(b))]
        assert defects.SuffixAutomaton(a).matches(b) == want


def test_mixture(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), rng.randint(1, 9)) for i in range(3000)]
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.19, 4), ("none", 0.01, 3)], "source string, target_share double, max_repeats int")
    mix, plan = mixture.mixture(spark.createDataFrame(docs, "i bigint, s string, t int"), "i", "s", "t", weights)
    used = mix.collect()
    uses = {}
    for r in used:
        uses[r.i] = uses.get(r.i, 0) + 1
    limit = {"big": 1, "mid": 2, "small": 4}
    assert all(n <= limit[docs[i][1]] for i, n in uses.items())
    shares = {r.source: r for r in mixture.reached(mix, plan, "i").collect()}
    for s, target in (("big", 0.5), ("mid", 0.3), ("small", 0.19)):
        assert abs(shares[s].reached_share - target / 0.99) < 0.005 and shares[s].met
    assert shares["none"].reached_share == 0 and not shares["none"].met
    again, _ = mixture.mixture(spark.createDataFrame(docs, "i bigint, s string, t int"), "i", "s", "t", weights)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used))


def test_temperature():
    have, target, repeats = [900.0, 90.0, 10.0], [0.2, 0.3, 0.5], [1.0, 2.0, 4.0]
    a = mixture.bisect_repeats(have, target, repeats, 500.0)
    w = mixture.tempered(have, target, a)
    assert 0 < a < 1 and all(500 * x <= r * h * 1.0001 for x, r, h in zip(w, repeats, have, strict=True))
    b = mixture.bisect_entropy([0.9, 0.09, 0.01], [1 / 3] * 3, 0.9)
    assert abs(mixture.entropy(mixture.tempered([0.9, 0.09, 0.01], [1 / 3] * 3, b)) - 0.9) < 1e-6
    plan = mixture.plan_mixture({"a": 900, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)}, budget=300)
    assert plan[1]["goal"] <= 30
