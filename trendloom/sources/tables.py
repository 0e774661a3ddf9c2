"""The persistent tables: Parquet folders with numbered versions and additions to them.

A new version is written beside the old one and counts once its write has committed, so a table
may be rewritten from itself and readers never see half a version. Added rows are a folder of their
own (``v3-<key>`` adds to ``v3``) and count as a whole once written, too; writing an addition again
under its key replaces it. The next version supersedes the additions to the last one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.schemas import TABLES

FOLDER = re.compile(r"v(\d+)(?:-(.+))?")


def _written(spark: SparkSession, root: str, name: str) -> list[tuple[int, str | None]]:
    """Version and key (none: the version itself) of all that has been written as a whole."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        path = status.getPath()
        named = FOLDER.fullmatch(path.getName())
        if named and files.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            found.append((int(named[1]), named[2]))
    return sorted(found, key=lambda f: (f[0], f[1] or ""))


def latest_version(spark: SparkSession, root: str, name: str) -> int:
    """The number of the latest version; 0 where none was written."""
    return max((v for v, key in _written(spark, root, name) if key is None), default=0)


def read_table(
    spark: SparkSession, root: str, name: str, version: int | None = None, without: str | None = None
) -> DataFrame:
    """The latest version (or that of a number) with its additions, except that of the key
    ``without``; an empty table where none was written."""
    schema = TABLES[name]
    written = _written(spark, root, name)
    if version is None:
        version = max((v for v, key in written if key is None), default=0)
    parts = [key for v, key in written if v == version and (key is None or key != without)]
    if not parts:
        return spark.createDataFrame([], schema)
    base = f"{root}/{name}/v{version}"
    return spark.read.schema(schema).parquet(*(base if key is None else f"{base}-{key}" for key in parts))


def _shaped(df: DataFrame, name: str) -> DataFrame:
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name]
        )
    )


def write_table(
    df: DataFrame, root: str, name: str, mode: str = "overwrite", version: int | None = None
) -> None:
    """Write the next version, or that of a number (``overwrite``), or add rows to the latest one
    (``append``)."""
    if mode == "append":
        add_rows(df, root, name, uuid.uuid4().hex)
    elif mode == "overwrite":
        if version is None:
            version = latest_version(df.sparkSession, root, name) + 1
        # a version left unfinished by a lost job is written over
        _shaped(df, name).write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    else:
        raise ValueError(f"unknown mode: {mode}")


def add_rows(df: DataFrame, root: str, name: str, key: str) -> None:
    """Add rows to the latest version; rows added before under this key go."""
    version = latest_version(df.sparkSession, root, name)
    _shaped(df, name).write.mode("overwrite").parquet(f"{root}/{name}/v{version}-{key}")


def read_mark(spark: SparkSession, root: str, first: str) -> str:
    """The stored high-water mark, or ``first`` before any import."""
    version = latest_version(spark, root, "mark")
    if not version:
        return first
    frame = spark.read.schema("update_date date").parquet(f"{root}/mark/v{version}")
    row = frame.agg(F.max("update_date")).first()
    return str(row[0]) if row[0] is not None else first


def write_mark(mark: DataFrame, root: str, version: int | None = None) -> None:
    if version is None:
        version = latest_version(mark.sparkSession, root, "mark") + 1
    mark.select("update_date").write.mode("overwrite").parquet(f"{root}/mark/v{version}")


BEGUN = "mark string, mark_version int, category_version int"


def begin_batch(spark: SparkSession, root: str, key: str, mark: str) -> dict:
    """What a batch starts from: the mark and the versions it reads. Noted before the batch writes
    anything, so that a batch that runs again starts from the same."""
    if not latest_version(spark, root, f"batches/{key}"):
        found = (mark, latest_version(spark, root, "mark"), latest_version(spark, root, "category"))
        noted = spark.createDataFrame([found], BEGUN)
        noted.coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/{key}/v1")
    return spark.read.schema(BEGUN).parquet(f"{root}/batches/{key}/v1").first().asDict()
