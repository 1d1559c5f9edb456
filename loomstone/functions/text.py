"""Scalar functions on text, as column expressions of built-in functions (Catalyst keeps them in one generated stage)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, as the inside of a regular expression class that Java and RE2 both read.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_RUN = r"[\p{L}\p{N}_]+"
SYMBOLS_V1 = r"[A-Z][A-Z0-9_]+"
SYMBOLS_V2 = r"\b[A-Z][A-Z_]+[A-Z]\b"
SYMBOLS_V3 = r"[A-Z][A-Z_]+[A-Z]"
QUOTED = r'"[^"]{4,}"'
PROSE = r"\b[a-z]{4,}\b"
NUMBER_LITERAL = r"\b\d+\.?\d*\b"
ASSIGNED = r"ARITH_EQUALS\s+#(\w+)"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def token_count(text: Column) -> Column:
    """Runs of anything but Unicode white space; null for null."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint")


def word_set(text: Column) -> Column:
    return F.array_distinct(find_all(F.lower(text), WORD_RUN))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def difficulty(words: Column) -> Column:
    """easy below 60 words, medium below 120, else hard; null for null."""
    return F.when(words < 60, "easy").when(words < 120, "medium").when(words >= 120, "hard")


def compression_ratio(chain_words: Column, cot_words: Column) -> Column:
    return F.bround(chain_words / F.greatest(cot_words, F.lit(1)), 4)


def sentence_steps(text: Column, most: int = 10) -> Column:
    """The first `most` parts between sentence ends, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(text, rf"[.!?][{SPACE}]+"), strip), lambda s: s != "")
    return F.slice(parts, 1, most)


def symbols(text: Column, version: int = 1) -> Column:
    """Symbols in a chain: v1 two characters or more, v2 and v3 three or more without digits, v2 at word boundaries."""
    return find_all(text, {1: SYMBOLS_V1, 2: SYMBOLS_V2, 3: SYMBOLS_V3}[version])


def prose_leak(chain: Column, version: int = 1) -> Column:
    """Quoted text, or lower-case words of four letters and more: over two without #variables (v1), over three with them (v2)."""
    text = F.regexp_replace(chain, "#[a-z][a-z0-9_]*", "") if version == 1 else chain
    words = F.filter(find_all(text, PROSE), lambda w: ~w.isin("true", "false", "null"))
    return chain.rlike(QUOTED) | (F.size(words) > (2 if version == 1 else 3))


def bare_head(chain: Column) -> Column:
    """A symbol with two arguments that no parenthesis opens."""
    return chain.rlike(r"(?<!\()([A-Z][A-Z_]{2,})\s+(\d[\d.]*|[A-Z][A-Z_]+)\s+(\d[\d.]*|[A-Z][A-Z_]+)(?!\s*\))")


def lambda_count(chain: Column) -> Column:
    return F.regexp_count(chain, F.lit("λ")).cast("bigint")


def error_kind(message: Column) -> Column:
    return F.substring_index(message, ":", 1)


def error_head(message: Column) -> Column:
    """The second word of an error message, null where there is none."""
    return F.get(F.filter(F.split(message, r"\s+"), lambda w: w != ""), F.lit(1))


def strip_fences(text: Column) -> Column:
    """Without a leading code fence (and its language) and a trailing one."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"^```[a-z]*\n?", ""), r"\n?```$", ""))


def strip_calculations(text: Column) -> Column:
    return F.regexp_replace(text, "<<[^>]*>>", "")


def orphaned_variables(chain: Column) -> Column:
    """Variables assigned by ARITH_EQUALS whose #name occurs once at most (as a prefix too)."""
    assigned = F.array_distinct(find_all(chain, ASSIGNED, 1))
    return F.filter(assigned, lambda v: (F.length(chain) - F.length(F.replace(chain, F.concat(F.lit("#"), v), F.lit("")))) <= F.length(v) + 1)


def underkill(question: Column, steps: Column) -> Column:
    return (F.regexp_count(question, F.lit("[.?!]")) >= 3) & (steps == 1)

