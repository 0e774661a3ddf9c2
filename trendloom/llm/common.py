"""Reading tables, empty texts and writing from tasks, shared by the operators of this package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text as a string, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` (settled, of a few numbers each) marked to be broadcast if there are at most
    ``most``; larger sides are joined by shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for mapInArrow that gives its freed memory back to the system when a task ends:
    Python workers wait for further tasks beside the next ones and would keep it."""

    def run(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return run


def pieces_of(total: int, each: int) -> int:
    """How many pieces of about ``each`` make up ``total``; at least one."""
    return max(1, -(-int(total or 0) // each))


def new_file(folder: str, stem: str) -> str:
    """A name no other attempt of the same task uses, so that a repeated task never overwrites."""
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """The file system that holds ``uri`` and the path in it; local files are memory mapped."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
