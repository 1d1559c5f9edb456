"""What the operators of this package share: words, and keys of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.scratch import materialise  # noqa: F401  used by every operator here

WORD_GAP = r"[^\p{L}\p{N}]+"


def word_text(text: Column) -> Column:
    """The words of a text (longest runs of Unicode letters and digits, lower-cased), one space between them."""
    return F.trim(F.lower(F.regexp_replace(text, WORD_GAP, " ")))


def text_key(words: Column) -> tuple[Column, Column, Column]:
    """96 bits of hash and the length: joins copies of a text without moving the text again."""
    return F.xxhash64(words), F.hash(words), F.length(words)
