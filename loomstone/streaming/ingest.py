"""Ingest that can stop and go on: file streams with a checkpoint instead of counting written rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_once(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, fmt: str = "parquet", transform=None) -> DataFrame:
    """Takes in what is new in a folder and ends; a second run goes on after the first. Returns what was written so far.

    The file sink and the checkpoint give each input row exactly once, also after a crash.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    stream = transform(stream) if transform else stream
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def ingest_new_keys(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str) -> DataFrame:
    """As ingest_once, but of rows with one key only the first that comes is written. The keys seen lie in the stream's own state, cut
    by their hash, so a batch touches the state of its keys and nothing of what was written is read again."""
    return ingest_once(spark, source, schema, target, checkpoint, transform=lambda stream: stream.dropDuplicates([key]))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by time window and key; on a stream, rows later than the watermark are passed over."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
