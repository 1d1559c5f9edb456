"""NumPy matrices as tables of vectors, read in row blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROWS_A_BLOCK = 50_000


def read_matrix(spark: SparkSession, path: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(vec_id, embedding) of a .npy file on a path that all executors see. The driver reads the header only; each block is
    mapped from the file where it is needed, in single precision."""
    n = np.load(path, mmap_mode="r").shape[0]
    blocks = max(1, -(-n // rows_a_block))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.load(path, mmap_mode="r")
        for pdf in batches:
            for b in pdf["id"]:
                part = np.asarray(m[b * rows_a_block : (b + 1) * rows_a_block], np.float32)
                yield pd.DataFrame({"vec_id": np.arange(len(part), dtype=np.int64) + b * rows_a_block, "embedding": list(part)})

    return spark.range(0, blocks, 1, blocks).mapInPandas(load, "vec_id bigint, embedding array<float>")


def embed_rows(df: DataFrame, row_id: str, text: str, make_model, dims: int) -> DataFrame:
    """(row_id, embedding): vectors of texts by a model made once a task, which maps a list of texts to a matrix. Null texts have none."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            m = np.asarray(model(pdf["t"].tolist()), np.float32).reshape(len(pdf), dims)
            yield pd.DataFrame({"i": pdf["i"], "embedding": list(m)})

    plain = df.where(df[text].isNotNull()).select(df[row_id].alias("i"), df[text].cast("string").alias("t"))
    return plain.mapInPandas(embed, f"i {plain.schema['i'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("i", row_id)
