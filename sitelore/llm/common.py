"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import hub_join, hub_size  # noqa: F401  for the operators
from ..scratch import release, scratch_path, shared_dir, written  # noqa: F401  for the operators

#: A word of the contracts: a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the queries.  Arrow batches are held to 8 MB, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_memory() -> None:
    """Give back what a worker's earlier tasks left: workers are used again, and their freed memory would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once in each task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc_fold(column, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows (all, if there are fewer), those of least key hash: the same rows on every run, chosen where they lie."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))
