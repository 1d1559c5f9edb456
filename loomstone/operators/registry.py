"""Registries of symbols: last row wins, insert if absent, overrides, defaults, type paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The type hierarchy, top type and its subtypes in order.
HIERARCHY = {
    "Entity": ["ConcreteEntity", "AbstractEntity"],
    "Relation": ["CausalRelation", "TemporalRelation", "SpatialRelation", "LogicalRelation"],
    "Property": ["NumericProperty", "QualitativeProperty"],
    "Process": ["CognitiveProcess", "PhysicalProcess"],
    "Logical": ["Quantifier", "Connective", "Comparator"],
    "Numeric": ["Cardinal", "Ordinal", "Operator"],
    "Modal": ["Epistemic", "Deontic"],
}
# Symbols dropped as noise, symbols switched off, types that get signatures.
DROPPED = ("SEMANTIC_VAGUE", "UNCLEAR_REQUEST", "QUASAR_OR_QUARTIC", "CONTEXTUAL_INCONSISTENCY", "CONTEXTUAL_WITH_PHRASE", "ABSTRACT_SYMBOL", "COMMON_CONCEPT_EXAMPLE", "STANDARD_CONCEPT")
SIGNABLE = ("Relation", "Process", "Logical", "Modal")
# Type paths that hold whatever a model said, by symbol.
FORCED_PATHS = {
    "ARITH_ADD": ("Numeric", "NumericProperty"),
    "ARITH_SUBTRACT": ("Numeric", "NumericProperty"),
    "ARITH_MULTIPLY": ("Numeric", "NumericProperty"),
    "ARITH_DIVIDE": ("Numeric", "NumericProperty"),
    "ARITH_EQUALS": ("Numeric", "NumericProperty"),
    "ARITH_MODULO": ("Numeric", "NumericProperty"),
    "LOGICAL_AND": ("Logical", "Connective"),
    "LOGICAL_OR": ("Logical", "Connective"),
    "LOGICAL_NOT": ("Logical", "Connective"),
    "LOGICAL_IMPLIES": ("Logical", "Connective"),
    "LOGICAL_IFF": ("Logical", "Connective"),
    "LOGICAL_XOR": ("Logical", "Connective"),
    "THEREFORE": ("Logical", "Connective"),
    "BECAUSE": ("Logical", "Connective"),
    "ASSUMES": ("Logical", "Connective"),
    "GIVEN": ("Logical", "Connective"),
    "FORALL": ("Logical", "Quantifier"),
    "EXISTS": ("Logical", "Quantifier"),
    "EXISTS_UNIQUE": ("Logical", "Quantifier"),
    "CONTRADICTS": ("Logical", "Comparator"),
    "KNOWN_TRUE": ("Modal", "Epistemic"),
    "BELIEVED_TRUE": ("Modal", "Epistemic"),
    "UNCERTAIN": ("Modal", "Epistemic"),
    "KNOWN_FALSE": ("Modal", "Epistemic"),
    "CAUSAL_ENABLES": ("Relation", "CausalRelation"),
    "CAUSAL_PREVENTS": ("Relation", "CausalRelation"),
    "CAUSAL_REQUIRES": ("Relation", "CausalRelation"),
    "CAUSAL_CONTRIBUTES": ("Relation", "CausalRelation"),
    "TEMPORAL_BEFORE": ("Relation", "TemporalRelation"),
    "TEMPORAL_AFTER": ("Relation", "TemporalRelation"),
    "TEMPORAL_DURING": ("Relation", "TemporalRelation"),
    "TEMPORAL_UNTIL": ("Relation", "TemporalRelation"),
    "IS_INSTANCE_OF": ("Relation", "LogicalRelation"),
    "IS_PART_OF": ("Relation", "LogicalRelation"),
    "IS_DEFINED_AS": ("Relation", "LogicalRelation"),
    "IS_EQUIVALENT_TO": ("Relation", "LogicalRelation"),
    "IS_GREATER_THAN": ("Relation", "LogicalRelation"),
    "IS_LESS_THAN": ("Relation", "LogicalRelation"),
    "IS_OPPOSITE_OF": ("Relation", "LogicalRelation"),
}


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the highest order of each key. Its columns are packed and the maximum taken, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    packed = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return packed.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing, and the rows of new whose key it hasn't; columns of either side that the other lacks are null."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def override(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of df replaced where `changes` has a row of the key with a value that isn't null."""
    columns = [c for c in changes.columns if c != key]
    joined = df.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_signatures(signatures: DataFrame, primitives: DataFrame) -> DataFrame:
    """(symbol, arity, domain_types, range_type): the signatures, and for symbols of signable types without one the default."""
    have = signatures.select("symbol", "arity", "domain_types", "range_type")
    missing = primitives.where(F.col("prim_type").isin(*SIGNABLE)).select("symbol").where("symbol is not null").distinct().join(have.select("symbol"), "symbol", "left_anti")
    default = F.lit("Entity|Process")
    return have.unionByName(missing.select("symbol", F.lit(2).alias("arity"), F.array(default, default).alias("domain_types"), F.lit("Relation").alias("range_type")))


def next_ids(existing: DataFrame, new: DataFrame, id_column: str, order: str) -> DataFrame:
    """new with ids P0001 ... that go on after the highest of existing, in the order of a column. `new` is a registry patch: its
    numbering sorts it in one task."""
    highest = existing.agg(F.coalesce(F.max(F.expr(f"try_cast(substring({id_column}, 2, 9) as int)")), F.lit(-1)).alias("_m"))
    numbered = new.withColumn("_n", F.row_number().over(W.orderBy(order))).crossJoin(F.broadcast(highest))
    return numbered.withColumn(id_column, F.format_string("P%04d", F.col("_m") + F.col("_n"))).drop("_m", "_n")


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def derive_type_path(kind: Column, subtype: Column, reclassify: Column) -> Column:
    """[new top] where a valid reclassification is given, else [top, subtype], the subtype defaulting to the first of the top ('Unknown' of others)."""
    first = F.coalesce(F.element_at(_map({k: F.lit(v[0]) for k, v in HIERARCHY.items()}), kind), F.lit("Unknown"))
    return F.when(reclassify.isin(*HIERARCHY), F.array(reclassify)).otherwise(F.array(kind, F.coalesce(subtype, first)))


def normalise_type_path(symbol: Column, kind: Column, path: Column) -> Column:
    """The path after the repairs: forced paths hold; an empty path is [type]; of an invented subtype the first of the top
    stands in. A path whose top is unknown is read as [type] but left as it was when nothing follows the top."""
    forced = _map({s: F.array(*map(F.lit, p)) for s, p in FORCED_PATHS.items()})
    firsts = _map({k: F.lit(v[0]) for k, v in HIERARCHY.items()})
    subtypes = [s for v in HIERARCHY.values() for s in v]
    top = F.get(path, F.lit(0))
    second = F.get(path, F.lit(1))
    invented = F.when(F.element_at(firsts, top).isNotNull(), F.array(top, F.element_at(firsts, top))).otherwise(F.array(top))
    return (
        F.when(F.element_at(forced, symbol).isNotNull(), F.element_at(forced, symbol))
        .when(path.isNull() | (F.size(path) == 0), F.array(kind))
        .when(~top.isin(*HIERARCHY) | (F.size(path) == 1) | second.isin(*subtypes), path)
        .otherwise(invented)
    )


def unknown_path_nodes(df: DataFrame, path: str) -> DataFrame:
    """(node, n): nodes of type paths outside the hierarchy."""
    known = [*HIERARCHY, *[s for v in HIERARCHY.values() for s in v]]
    nodes = df.select(F.explode(path).alias("node"))
    return nodes.where(~F.col("node").isin(*known)).groupBy("node").agg(F.count("*").alias("n"))
