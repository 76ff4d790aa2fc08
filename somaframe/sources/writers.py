"""Text sinks and the scratch folder for intermediate tables.

Between jobs use Parquet; the text forms are for hand-over to other tools. Each
sink writes a directory of part files, one per partition, with a header in each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


_PATHS: list[str] = []
_INNER: ContextVar[list[str] | None] = ContextVar("inner stages", default=None)
NO_COMMENT = "\u0002"  # else values starting with "#" would be quoted


def _save(writer: DataFrameWriter, path: str, by: str | None, compression: str | None) -> None:
    if by is not None:
        writer = writer.partitionBy(by)
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_tsv(
    df: DataFrame, path: str, null_token: str = "NA", by: str | None = None,
    compression: str | None = None, mode: str = "errorifexists",
) -> None:
    """Tab text with header and ``NA`` for a missing value; blank stays blank.
    With ``by`` there is a directory per value, ``by=value``."""
    writer = (
        df.write.mode(mode).option("sep", "\t").option("header", "true").option("escape", '"')
        .option("nullValue", null_token).option("emptyValue", "").option("comment", NO_COMMENT)
    )
    _save(writer, path, by, compression)


def write_plain_tsv(
    df: DataFrame, path: str, by: str | None = None,
    compression: str | None = None, mode: str = "errorifexists",
) -> None:
    """Tab text with header, unquoted, blank for a missing value."""
    writer = (
        df.write.mode(mode).option("sep", "\t").option("header", "true").option("quote", "")
        .option("nullValue", "").option("emptyValue", "").option("comment", NO_COMMENT)
    )
    _save(writer, path, by, compression)


def write_id_list(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """One column, no header; a missing id is written as ``NA``."""
    df.select(column).write.mode(mode).option("nullValue", "NA").csv(path)


def write_stage(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Hand-over between jobs: Parquet, in one directory per value of ``by``."""
    writer = df.write.mode(mode)
    (writer if by is None else writer.partitionBy(by)).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``. Where
    that is unset, below the warehouse if the session runs on one machine; on a
    cluster it is an error, as the warehouse may be a folder of the driver only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    if (inner := _INNER.get()) is not None:
        inner.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written once below the shared folder and read back.

    For results that several branches of a plan use: the work before is done a
    single time, whatever the planner makes of the branches, and losing an
    executor later costs a re-read only. Runs a job when called.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_whole(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make()`` returns, staged. What is staged on the way is not
    read any more by then and is removed; after an error it is left to
    ``remove_staged``."""
    outer, inner = _INNER.get(), []
    mark = _INNER.set(inner)
    try:
        whole = staged(make(), name)
    finally:
        _INNER.reset(mark)
    path = inner.pop()
    for done in inner:
        _remove(spark, done)
        _PATHS.remove(done)
    if outer is not None:
        outer.append(path)
    return whole


def _remove(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_staged(spark: SparkSession) -> int:
    """Remove what this process has staged so far; for the owner of a job, once
    its results are written. Returns the number of folders removed."""
    removed = 0
    while _PATHS:
        removed += _remove(spark, _PATHS.pop())
    return removed
