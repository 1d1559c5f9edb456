"""The callable surface in SQL: scalar functions, table functions and aggregates under one session."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import answers, chain


class ParseNodes:
    """parse_nodes(chain): the node table of a chain, no row where it can't be parsed."""

    def eval(self, text: str):
        try:
            nodes = chain.read_nodes(text or "")
        except chain.ChainError:
            return
        for i, n in enumerate(nodes):
            yield i, None if n.parent < 0 else n.parent, n.depth, n.ord, n.kind, n.head, n.lexeme, len(n.args)


class TopLevel:
    """top_level_exprs(text): the groups of a text, in order."""

    def eval(self, text: str):
        work = chain.Pieces.of(text or "")
        for i, (a, b) in enumerate(work.spans()):
            yield i, chain._spaced(work.all[a:b])


def _number(text: str) -> float | None:
    return float(text) if re.fullmatch(answers.READABLE.strip("^$"), text) else None


def _normal(text: str) -> str:
    t = re.sub("[,$%]", "", text.strip(chain.UNICODE_SPACE).lower())
    n = _number(t)
    if n is None or not abs(n) < float(1 << 53):
        return t
    return str(int(n)) if n == int(n) else repr(n)


@F.pandas_udf(T.StringType())
def normalize_answer(text: pd.Series) -> pd.Series:
    """answers.normalise for SQL."""
    return pd.Series([None if t is None else _normal(t) for t in text], dtype=object)


@F.pandas_udf(T.BooleanType())
def score_answer(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """answers.matches for SQL."""
    out = []
    for p, g in zip(predicted, gold, strict=True):
        p, g = (_normal(x) if x is not None else "" for x in (p, g))
        a, b = _number(p), _number(g)
        out.append(bool(p and g) and (p == g or (abs(a - b) < 1e-4 if a is not None and b is not None else p in g or g in p)))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.ArrayType(T.DoubleType()), F.PandasUDFType.GROUPED_AGG)
def vector_mean(v: pd.Series):
    """The mean of the vectors of a group; null ones don't count."""
    v = v.dropna()
    return np.mean(np.array(v.tolist(), np.float64), axis=0).tolist() if len(v) else None


COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE
  RETURN IF(size(a) = size(b), aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)
  / (sqrt(aggregate(a, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x)) + 1e-8), NULL)"""
ASSEMBLE = """CREATE OR REPLACE TEMPORARY FUNCTION assemble_chain(steps ARRAY<STRING>) RETURNS STRING
  RETURN IF(size(steps) = 0, '', aggregate(slice(reverse(steps), 2, greatest(size(steps) - 1, 0)), element_at(steps, -1), (acc, x) -> concat('[', x, ' ', acc, ']')))"""
BLOCKS = r"""CREATE OR REPLACE TEMPORARY FUNCTION extract_block(text STRING, tag STRING) RETURNS STRING
  RETURN coalesce(regexp_extract(text, concat('(?s)<', tag, '>\\s*(.*?)\\s*</', tag, '>'), 1), '')"""


def register(spark: SparkSession, signatures: DataFrame, ontology: dict[str, list[str]] | None = None) -> None:
    """Registers validate, validate_strict, auto_repair, lower_variables, normalize_answer, score_answer, assemble_chain, extract_block
    and cosine, the aggregate vector_mean, and the table functions parse_nodes and top_level_exprs, for spark.sql."""
    sigs = chain.signature_map(signatures)
    spark.udf.register("validate", chain.validator(sigs))
    spark.udf.register("validate_strict", chain.validator(sigs, ontology or {}))
    spark.udf.register("auto_repair", chain.auto_repair)
    spark.udf.register("lower_variables", chain.lower_variables)
    spark.udf.register("normalize_answer", normalize_answer)
    spark.udf.register("score_answer", score_answer)
    spark.udf.register("vector_mean", vector_mean)
    for statement in (COSINE, ASSEMBLE, BLOCKS):
        spark.sql(statement)
    spark.udtf.register("parse_nodes", F.udtf(ParseNodes, returnType=chain.NODE))
    spark.udtf.register("top_level_exprs", F.udtf(TopLevel, returnType="pos int, expr string"))

