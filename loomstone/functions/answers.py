"""Answers: taking them out of generated text, normalising and comparing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import SPACE, find_all, strip

# Numbers as texts hold them, and what a number may look like to be read as one.
NUMBER_RUN = r"-?[\d,]+\.?\d*"
READABLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: written out again and again, nested patterns outgrow a generated method."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def block(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, trimmed; an empty string where there is none."""
    return F.coalesce(F.regexp_extract(text, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))


def direct_answer(text: Column) -> Column:
    """The first number after the last 'Answer:', else the first 50 characters there."""
    tail = F.when(text.contains("Answer:"), strip(F.substring_index(text, "Answer:", -1))).otherwise(text)
    found = find_all(F.replace(tail, F.lit(","), F.lit("")), NUMBER_RUN)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(strip(F.substring(tail, 1, 50)))


def cot_answer(text: Column) -> Column:
    """After the last 'Question:', the last 'answer is N', else the last number, else the first 50 characters."""
    tail = F.substring_index(text, "Question:", -1)
    said = find_all(tail, r"(?i)answer is[:\s]*\(?\$?(-?[\d,]+\.?\d*)", 1)
    numbers = find_all(F.replace(tail, F.lit(","), F.lit("")), NUMBER_RUN)
    return F.when(F.size(said) > 0, last(said)).when(F.size(numbers) > 0, last(numbers)).otherwise(strip(F.substring(tail, 1, 50)))


def first_number(text: Column) -> Column:
    """The text itself if it is a number, else the first number in it (commas removed, so it may be empty), else null."""
    t = strip(text)
    found = find_all(t, NUMBER_RUN)
    return F.when(t.rlike(r"^-?[\d,]+\.?\d*$"), F.replace(t, F.lit(","), F.lit(""))).when(F.size(found) > 0, F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit("")))


def boxed(text: Column) -> Column:
    r"""The last \boxed{...}, else the first 50 characters."""
    found = find_all(text, r"\\boxed\{([^}]+)\}", 1)
    return F.when(F.size(found) > 0, last(found)).otherwise(F.substring(text, 1, 50))


def as_number(text: Column) -> Column:
    return F.when(text.rlike(READABLE), text.try_cast("double"))


def normalise(text: Column, collapse: bool = False) -> Column:
    """Trimmed, lower case, without , $ and %; whole numbers without a fraction. collapse: runs of white space become one.

    Numbers beyond 2^53 keep their text, as do inf and nan.
    """
    t = F.regexp_replace(F.lower(strip(text)), "[,$%]", "")
    if collapse:
        t = F.regexp_replace(t, f"[{SPACE}]+", " ")
    exact = float(1 << 53)
    whole = lambda n: (n == F.floor(n)) & (F.abs(n) < exact)
    shown = lambda t: let(as_number(t), lambda n: F.when(whole(n), n.cast("bigint").cast("string")).when(n.isNotNull() & (F.abs(n) < exact), n.cast("string")).otherwise(t))
    return let(t, shown)


def matches(predicted: Column, gold: Column, compat: bool = False) -> Column:
    """Equal once normalised, or numbers less than 0.0001 apart, or, if not both numbers, one inside the other.

    A blank prediction or gold is wrong, unless compat: then it is inside anything.
    """

    def compare(p: Column, g: Column, a: Column, b: Column) -> Column:
        inside, same = p.contains(g) | g.contains(p), p == g
        if not compat:
            inside, same = inside & (p != "") & (g != ""), same & (p != "")
        return F.coalesce(same | F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-4).otherwise(inside), F.lit(False))

    sides = F.struct(normalise(predicted).alias("p"), normalise(gold).alias("g"))
    numbers = lambda s: F.struct(s["p"].alias("p"), s["g"].alias("g"), as_number(s["p"]).alias("a"), as_number(s["g"]).alias("b"))
    return let(let(sides, numbers), lambda s: compare(s["p"], s["g"], s["a"], s["b"]))
