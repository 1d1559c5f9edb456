"""A data source for spark.read.format("npy"): NumPy matrices as (vec_id, embedding)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class RowBlock(InputPartition):
    start: int
    stop: int


class NpyReader(DataSourceReader):
    """Splits the rows of a matrix into blocks; each task maps its own block from the file."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.rows = int(options.get("rowsPerPartition", "50000"))

    def partitions(self) -> list[RowBlock]:
        n = np.load(self.path, mmap_mode="r").shape[0]
        return [RowBlock(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [RowBlock(0, 0)]

    def read(self, partition: RowBlock):
        m = np.load(self.path, mmap_mode="r")
        for a in range(partition.start, partition.stop, 4096):
            b = min(partition.stop, a + 4096)
            part = np.asarray(m[a:b], np.float32)
            offsets = np.arange(b - a + 1, dtype=np.int32) * part.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int64)), vectors], names=["vec_id", "embedding"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> NpyReader:  # noqa: ARG002
        return NpyReader(self.options)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
