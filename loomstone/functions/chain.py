"""The chain language: reading, checking and repairing S-expression chains.

    expr  := atom | (HEAD expr*) | (λ VAR : TYPE . expr) | {expr | CONF} | [expr expr+]
    atom  := SYMBOL | NUMBER | #VAR | VAR

White space and comments (; to the end of the line) may stand between any two tokens. What a token may be depends on
what is expected, and each is read as far as it goes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens of the language.
GAP = re.compile(r"(?:[ \t\f\r\n]+|;[^\n]*)*")
HEAD = re.compile(r"[A-Z][A-Z0-9_]*")
VAR = re.compile(r"[a-z][a-z0-9_]*")
TYPE = re.compile(r"[A-Z][A-Za-z]*")
CONF = re.compile(r"0(?:\.\d+)?|1(?:\.0+)?")
NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?")
UNICODE_SPACE = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"

PARSE_ERROR, UNKNOWN_SYMBOL, ARITY_MISMATCH, TYPE_ERROR = "PARSE_ERROR", "UNKNOWN_SYMBOL", "ARITY_MISMATCH", "TYPE_ERROR"

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("head", T.StringType()),
        T.StructField("lexeme", T.StringType()),
        T.StructField("n_args", T.IntegerType(), False),
    ]
)
VERDICT = T.StructType([T.StructField("ok", T.BooleanType(), False), T.StructField("err_kind", T.StringType()), T.StructField("err", T.StringType())])


class ChainError(ValueError):
    """A chain that can't be read."""


@dataclass
class Node:
    """One expression. lexeme holds an atom's text, a λ's variable and type, or an assertion's confidence."""

    kind: str
    parent: int
    depth: int
    ord: int
    head: str | None = None
    lexeme: str | None = None
    args: list[int] = field(default_factory=list)


def read_nodes(text: str) -> list[Node]:
    """The expressions of a chain, outermost first, in the order in which they begin. Depth isn't limited by recursion.

    Raises ChainError where the text leaves the language.
    """
    s = text.strip(UNICODE_SPACE)
    nodes: list[Node] = []
    open_nodes: list[int] = []
    at = GAP.match(s, 0).end()

    def fail(what: str) -> ChainError:
        return ChainError(f"{PARSE_ERROR}: expected {what} at {at}")

    def take(pattern: re.Pattern, what: str) -> str:
        nonlocal at
        m = pattern.match(s, at)
        if not m:
            raise fail(what)
        at = GAP.match(s, m.end()).end()
        return m.group()

    def sign(ch: str) -> None:
        nonlocal at
        if not s.startswith(ch, at):
            raise fail(ch)
        at = GAP.match(s, at + len(ch)).end()

    def begin(kind: str, head: str | None = None, lexeme: str | None = None) -> None:
        parent = open_nodes[-1] if open_nodes else -1
        order = 0
        if parent >= 0:
            order = len(nodes[parent].args)
            nodes[parent].args.append(len(nodes))
        nodes.append(Node(kind, parent, len(open_nodes), order, head, lexeme))

    done = False
    while not done:
        # one expression begins here
        ch = s[at : at + 1]
        if ch == "(":
            sign("(")
            if s.startswith("λ", at):
                sign("λ")
                variable = take(VAR, "a variable")
                sign(":")
                kind = take(TYPE, "a type")
                sign(".")
                begin("abstraction", None, f"{variable}:{kind}")
            else:
                begin("application", take(HEAD, "a head"))
            open_nodes.append(len(nodes) - 1)
        elif ch == "{" or ch == "[":
            sign(ch)
            begin("assertion" if ch == "{" else "sequence")
            open_nodes.append(len(nodes) - 1)
        elif ch == "#":
            sign("#")
            begin("variable", None, take(VAR, "a variable"))
        elif HEAD.match(s, at):
            begin("symbol", None, take(HEAD, "a symbol"))
        elif VAR.match(s, at):
            begin("bound", None, take(VAR, "a variable"))
        elif NUMBER.match(s, at):
            begin("number", None, take(NUMBER, "a number"))
        elif ch == ")" and open_nodes and nodes[open_nodes[-1]].kind == "application":
            pass  # an application may have no arguments: it is closed below
        else:
            raise fail("an expression")
        if nodes and open_nodes and open_nodes[-1] == len(nodes) - 1 and ch != ")":
            if not (nodes[-1].kind == "application" and s.startswith(")", at)):
                continue  # its first member comes next
        # close what ends here
        while True:
            if not open_nodes:
                done = True
                break
            top = nodes[open_nodes[-1]]
            if top.kind == "application":
                if not s.startswith(")", at):
                    break
                sign(")")
            elif top.kind == "abstraction":
                sign(")")
            elif top.kind == "assertion":
                sign("|")
                top.lexeme = take(CONF, "a confidence")
                sign("}")
            else:
                if len(top.args) < 2 or not s.startswith("]", at):
                    break
                sign("]")
            open_nodes.pop()
    if at < len(s):
        raise fail("the end")
    return nodes


@dataclass(frozen=True)
class Signature:
    arity: int
    domain: tuple[str, ...] = ()
    range: str = "Unknown"


def _paths(nodes: list[Node], signatures: dict[str, Signature], ontology: dict[str, list[str]]) -> list[list[str] | None]:
    """The type path of every expression, None where nothing is known."""
    out: list[list[str] | None] = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # members come after what holds them
        n = nodes[i]
        if n.kind == "number":
            out[i] = ["Numeric"]
        elif n.kind == "symbol":
            out[i] = ontology.get(n.lexeme)
        elif n.kind == "application" and n.head in signatures:
            out[i] = [signatures[n.head].range]
        elif n.kind == "assertion":
            out[i] = out[n.args[0]]
        elif n.kind == "sequence":
            out[i] = ["Sequence"]
    return out


def first_error(nodes: list[Node], signatures: dict[str, Signature], ontology: dict[str, list[str]] | None = None) -> tuple[str, str] | None:
    """(kind, message) of the first application that breaks its signature: deepest first, then left to right.

    Without signatures nothing is checked. With an ontology, arguments are also held against the domains; what can't be
    inferred passes.
    """
    if not signatures:
        return None
    paths = _paths(nodes, signatures, ontology) if ontology is not None else None
    for i in sorted((i for i, n in enumerate(nodes) if n.kind == "application"), key=lambda i: (-nodes[i].depth, i)):
        n = nodes[i]
        known = signatures.get(n.head)
        if known is None:
            return UNKNOWN_SYMBOL, f"{UNKNOWN_SYMBOL}: {n.head}"
        if len(n.args) != known.arity:
            return ARITY_MISMATCH, f"{ARITY_MISMATCH}: {n.head} expects {known.arity} args, got {len(n.args)}"
        if paths is not None:
            for place, (arg, wanted) in enumerate(zip(n.args, known.domain, strict=False), 1):
                if paths[arg] is not None and not set(wanted.split("|")) & set(paths[arg]):
                    return TYPE_ERROR, f"{TYPE_ERROR}: {n.head} arg{place} expects {wanted}, got {'/'.join(paths[arg])}"
    return None


def verdict(text: str | None, signatures: dict[str, Signature], ontology: dict[str, list[str]] | None = None) -> tuple[bool, str | None, str | None]:
    """(ok, kind of error, message). A null chain is read as an empty one, which can't be parsed."""
    try:
        nodes = read_nodes(text or "")
    except ChainError as e:
        return False, PARSE_ERROR, str(e)
    wrong = first_error(nodes, signatures, ontology)
    return (True, None, None) if wrong is None else (False, *wrong)


# --- repair --------------------------------------------------------------------------------------------------------------
PIECES = re.compile(r"[()\[\]{}]|[^\s()\[\]{}]+")
BARE_HEAD = re.compile(r"[A-Z][A-Z0-9_]+")
PARTNER = {"(": ")", "[": "]", "{": "}"}
CLOSERS = frozenset(PARTNER.values())


@dataclass
class Pieces:
    """The pieces of a text, where each opening bracket closes (counting its own kind only), and which pieces are bare heads."""

    all: list[str]
    closed: dict[int, int]
    heads: list[bool]

    @classmethod
    def of(cls, text: str) -> Pieces:
        pieces = PIECES.findall(text)
        closed: dict[int, int] = {}
        waiting: dict[str, list[int]] = {c: [] for c in CLOSERS}
        for i, piece in enumerate(pieces):
            if piece in PARTNER:
                waiting[PARTNER[piece]].append(i)
            elif piece in CLOSERS and waiting[piece]:
                closed[waiting[piece].pop()] = i
        return cls(pieces, closed, [BARE_HEAD.fullmatch(piece) is not None for piece in pieces])

    def after(self, lo: int, hi: int) -> int:
        """Behind the bracket that closes the one at lo; one that never closes ends with the range."""
        return min(self.closed.get(lo, hi - 1) + 1, hi)

    def group_end(self, lo: int, hi: int) -> int:
        """Where the top-level group at lo ends: a bracketed range, a bare head with what follows up to the next head or closer, or one piece."""
        if self.all[lo] in PARTNER:
            return self.after(lo, hi)
        end = lo + 1
        if self.heads[lo]:
            while end < hi and self.all[end] not in CLOSERS and not self.heads[end]:
                end = self.after(end, hi) if self.all[end] in PARTNER else end + 1
        return end

    def spans(self) -> list[tuple[int, int]]:
        out, at = [], 0
        while at < len(self.all):
            end = self.group_end(at, len(self.all))
            out.append((at, end))
            at = end
        return out

    def argument_end(self, lo: int, hi: int) -> int:
        """Where a bare head among the arguments of a bare head ends: at the next head, or where a bracket closes."""
        end = lo + 1
        while end < hi and not self.heads[end] and self.all[end] not in (")", "]"):
            end += 1
        return end

    def repaired(self) -> list[str]:
        """All pieces in one pass. What is still to be written lies on a stack: ranges, and the brackets that come after them. A range is of
        top-level expressions (wrap "each"), of arguments in brackets, which stand as they are ("none"), or of arguments of a bare head ("heads")."""
        out: list[str] = []
        todo: list[tuple[int, int, str]] = [(0, len(self.all), "each")]
        while todo:
            lo, hi, wrap = todo.pop()
            if hi < 0:
                out.append(wrap)
                continue
            while lo < hi:
                piece = self.all[lo]
                if piece in ("(", "["):
                    end, opener, closer, first, last, inside = self.after(lo, hi), piece, PARTNER[piece], lo + 1, -1, "none" if piece == "(" else "each"
                elif self.heads[lo] and wrap != "none":
                    end, opener, closer, first, last, inside = self.group_end(lo, hi) if wrap == "each" else self.argument_end(lo, hi), "(", ")", lo, 0, "heads"
                else:
                    end = self.group_end(lo, hi) if wrap == "each" else lo + 1
                    out += self.all[lo:end]
                    lo = end
                    continue
                out.append(opener)
                if first == lo:
                    out.append(piece)
                todo += [(end, hi, wrap), (0, -1, closer), (lo + 1, end + last, inside)]
                break
        return out


def _spaced(pieces: list[str]) -> str:
    """Pieces with one space between them, none inside brackets."""
    parts: list[str] = []
    for i, piece in enumerate(pieces):
        if i and pieces[i - 1] not in PARTNER and piece not in CLOSERS:
            parts.append(" ")
        parts.append(piece)
    return "".join(parts)


def repair(text: str) -> str:
    """Puts bare heads in parentheses and several top-level expressions into one sequence; blank text is only trimmed.

    Brackets that never close end at the last piece, which is lost inside them; braces are left as they are.
    """
    pieces = Pieces.of(text)
    if not pieces.all:
        return text.strip(UNICODE_SPACE)
    fixed = _spaced(pieces.repaired())
    return fixed if len(pieces.spans()) == 1 else f"[{fixed}]"


def _each(values: pd.Series, work) -> list:
    """work of every value, done once for each distinct value of the batch."""
    codes, distinct = pd.factorize(values.fillna(""), use_na_sentinel=False)
    done = [work(v) for v in distinct]
    return [done[c] for c in codes]


# --- columns -------------------------------------------------------------------------------------------------------------
def signature_map(signatures: DataFrame, limit: int = 1_000_000) -> dict[str, Signature]:
    """Signatures by symbol, the row with the highest pos holding; a null arity counts as 0. Refuses more than `limit` symbols."""
    last = signatures.where("symbol is not null").groupBy("symbol").agg(F.max_by(F.struct("arity", "domain_types", "range_type"), F.struct(F.coalesce("pos", F.lit(-1)), F.coalesce("arity", F.lit(0)))).alias("s")).select("symbol", "s.*")
    rows = last.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} symbols: join node tables with the signatures instead")
    return {r.symbol: Signature(r.arity or 0, tuple(r.domain_types or ()), r.range_type or "Unknown") for r in rows}


def ontology_map(primitives: DataFrame, limit: int = 1_000_000) -> dict[str, list[str]]:
    """Type paths by symbol, of several the greatest. Refuses more than `limit` symbols."""
    rows = primitives.where("symbol is not null and type_path is not null").groupBy("symbol").agg(F.max("type_path").alias("path")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} symbols")
    return {r.symbol: list(r.path) for r in rows}


def validator(signatures: dict[str, Signature], ontology: dict[str, list[str]] | None = None):
    """UDF chain -> struct<ok, err_kind, err>. Non-deterministic for the optimiser, so that it runs once a row, not once a field."""

    @F.pandas_udf(VERDICT)
    def validate(chain: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_each(chain, lambda c: verdict(c, signatures, ontology)), columns=["ok", "err_kind", "err"])

    return validate.asNondeterministic()


@F.pandas_udf(T.StringType())
def auto_repair(chain: pd.Series) -> pd.Series:
    return pd.Series(_each(chain, repair), dtype=object).where(chain.notna().to_numpy(), None)


@F.pandas_udf(T.ArrayType(NODE))
def parse_nodes(chain: pd.Series) -> pd.Series:
    """The node table of a chain; null where it can't be parsed."""

    def rows(c: str) -> list[dict] | None:
        try:
            nodes = read_nodes(c)
        except ChainError:
            return None
        return [{"node_id": i, "parent_id": None if n.parent < 0 else n.parent, "depth": n.depth, "ord": n.ord, "kind": n.kind, "head": n.head, "lexeme": n.lexeme, "n_args": len(n.args)} for i, n in enumerate(nodes)]

    return pd.Series(_each(chain, rows), dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def top_level_exprs(chain: pd.Series) -> pd.Series:
    """The top-level groups of a text, each in canonical spacing."""
    out = []
    for c in chain:
        pieces = Pieces.of(c or "")
        out.append([_spaced(pieces.all[a:b]) for a, b in pieces.spans()])
    return pd.Series(out, dtype=object)


def assemble(steps: Column) -> Column:
    """Steps nested to the right: [a [b c]]; one step is itself, none an empty string."""
    n = F.size(steps)
    folded = F.aggregate(F.slice(F.reverse(steps), 2, F.greatest(n - 1, F.lit(0))), F.element_at(steps, -1), lambda acc, x: F.concat(F.lit("["), x, F.lit(" "), acc, F.lit("]")))
    return F.when(n == 0, F.lit("")).otherwise(folded)


@F.pandas_udf(T.StringType())
def lower_variables(chain: pd.Series) -> pd.Series:
    """#NAME becomes #name."""
    return chain.str.replace(r"#([A-Z][A-Z0-9_]*)", lambda m: "#" + m.group(1).lower(), regex=True)


@F.pandas_udf(T.StringType())
def highlight(chain: pd.Series, unknown: pd.Series) -> pd.Series:
    """The symbols of a chain that are in its array `unknown`, as [!SYMBOL!]."""
    out = []
    for c, k in zip(chain, unknown, strict=True):
        names = set(k if k is not None else ())
        out.append(None if c is None else re.sub(r"[A-Z][A-Z_]+[A-Z]", lambda m: f"[!{m.group()}!]" if m.group() in names else m.group(), c))  # noqa: B023
    return pd.Series(out, dtype=object)
