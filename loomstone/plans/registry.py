"""How queries are registered: a function, its name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def with_share(counts: DataFrame, n: str = "n", out: str = "share") -> DataFrame:
    """Adds the share of all of each row's count. For counted categories: few rows, summed in one task, so that what was counted
    isn't counted again for its total."""
    return counts.withColumn(out, F.col(n) / F.sum(n).over(W.partitionBy()))


def table(spark: SparkSession, sf_dir: str, name: str, python: bool = False) -> DataFrame:
    """A table as it was written. python: for work in Python (or costly patterns), a table in fewer pieces than there are cores is
    spread over them, as reading is then quicker than what follows; larger tables come in more pieces and stay as they are."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if python and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df
