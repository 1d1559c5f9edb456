"""Files of JSON: lines, documents and arrays; strict and forgiving scans; append, overwrite and merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; a bad line fails the job, a blank one is passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A document that is an array of objects, one row an object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def lines_to_rows(df: DataFrame, raw: str, schema: str, keep: list[str]) -> DataFrame:
    """Columns of JSON lines that are already in a table; lines that are no object have nulls and readable = false."""
    parsed = F.from_json(raw, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = df.select(*keep, parsed.alias("_p"))
    return rows.select(*keep, (F.col("_p").isNotNull() & F.col("_p._bad").isNull()).alias("readable"), "_p.*").drop("_bad")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One row as one JSON document."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def merge_stats(existing: DataFrame, update: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Key/value rows: those of `update` replace those of `existing`."""
    return update.select(key, value).unionByName(existing.select(key, value).join(update.select(key), key, "left_anti"))


def write_if_any(df: DataFrame, flagged: str, path: str) -> bool:
    """Writes the rows that aren't flagged, but only if a row is; tells whether it did."""
    if df.where(flagged).isEmpty():
        return False
    overwrite(df.where(f"not ({flagged})"), path)
    return True


def first_that_reads(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first reader that has a schema to give; the last error if none has."""
    error: Exception | None = None
    for r in readers:
        try:
            df = r()
            df.schema  # noqa: B018
            return df
        except Exception as e:  # noqa: BLE001
            error = e
    raise error or ValueError("no reader")
