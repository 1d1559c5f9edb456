"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is set and all runs on one machine, as in
    tests, one of our own; on other clusters a folder of this machine would be no use, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomstone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> str:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver's JVM ends."""
    return forget_at_exit(spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it back, which cuts the lineage. The files outlive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files when it ends; else they stay until the driver happens to collect its garbage.
    Only for tables that are executed once: executed again, they would be shuffled again."""
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as workers need it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def arrow_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """How a worker reads a qualified path, without Spark."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all: written beside its place and moved there."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        raise OSError(f"{path} is there already")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
