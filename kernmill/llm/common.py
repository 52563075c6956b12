"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, forget, shared_dir, shared_path, written

__all__ = ["chunks", "cut", "forget", "quiet_tokenizers", "shared_dir", "shared_path", "table", "texts", "with_text", "written"]

#: Texts handed to one Python loop at a time hold about so many bytes, or are one text.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about `most` bytes of column `text`, so that
    the memory of a worker follows the longest text and not the batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size + 64
        yield batch.slice(start)


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the columns in more."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def quiet_tokenizers() -> None:
    """One thread a worker: the executor's cores are shared out by Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
