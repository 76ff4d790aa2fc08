"""Helpers of the corpus operators: tables, checked broadcasts, row filters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_ROWS = 1_000  # whole texts passed to Python at once
BROADCAST_ROWS = 1_000_000  # largest side sent to every executor, in rows of a few numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch for what is written meanwhile: whole
    texts in batches of the default size fill the memory outside of Spark's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """What Arrow and the C library hold without need goes back to the system.
    Workers outlive their tasks and share a machine's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with a release after each."""
    for batch in batches:
        yield batch
        del batch
        release()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if its counted rows are at most ``rows``;
    else as it is, so that the join shuffles. For staged tables, as it counts."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: Column) -> Column:
    """Tells apart rows that share a document id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not in ``dropped`` (staged, the key and text_key): a
    row goes if both its id, missing ones being equal, and its text are there.
    Columns stay."""
    gone = small_side(dropped.select(F.col(key).alias("_gone"), F.col("text_key").alias("_gone_text")).distinct())
    same = F.col(key).eqNullSafe(F.col("_gone")) & text_key(F.col(text_col)).eqNullSafe(F.col("_gone_text"))
    return docs.join(gone, same, "left_anti")
