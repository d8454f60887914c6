"""Intermediate tables and files in the folder that driver and executors share, rows' numbers, and sizes of batches."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.sources.shared import materialize, new_path, shared_dir  # noqa: F401

BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of ``BATCH_BYTES`` at most, whatever their length; a long text is one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


#: Column of ``numbered`` tables; unlike a doc_id it is never null and stands on one row.
ROW = "__lociframe_row"
_FILE, _PLACE, _NUMBER = "__lociframe_file", "__lociframe_place", "__lociframe_number"


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row in ``ROW``, written, so that all who read it see the same numbers.

    A table that has them already was written with them and comes back as it is.
    """
    return df if ROW in df.columns else materialize(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def numbered_file_rows(df: DataFrame, name: str) -> DataFrame:
    """``numbered`` for a table as it was read from Parquet files: a row's number is that of its file and its place there.

    Nothing is copied, as each scan finds the same numbers. What was not read from such
    files is written by ``numbered``; rows made of one row of a file, as by ``explode``, have
    to be written first.
    """
    if ROW in df.columns:
        return df
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_PLACE))
    except AnalysisException:
        return numbered(df, name)
    files = materialize(df.select(F.col("_metadata.file_path").alias(_FILE)).distinct(), "files")
    files = files.select(_FILE, (F.row_number().over(Window.orderBy(_FILE)) - 1).cast("long").alias(_NUMBER))  # one row a file
    files = F.broadcast(files) if files.count() <= 100_000 else files
    return placed.join(files, _FILE).withColumn(ROW, F.shiftleft(_NUMBER, 40).bitwiseOR(F.col(_PLACE))).select(*columns(df), ROW)


def plain(df: DataFrame) -> DataFrame:
    """``df`` without its rows' numbers."""
    return df.drop(ROW)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI, and the path on it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def discard(path: str) -> None:
    """Delete a folder below the shared one that nothing reads any more."""
    fs, at = filesystem(path)
    fs.delete_dir(at)


def write_whole(path: str, write) -> None:
    """Let ``write(stream)`` fill a file that appears under its name only once complete.

    A retried or speculative task writes the same content, so the last rename wins.
    """
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, at)
