"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trendloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


TASK_ROWS = 250_000  # of narrow rows that a task sorts or groups


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many narrow rows: as many as Spark would take, or more, so that none
    holds more than about ``TASK_ROWS`` of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and working tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="trendloom-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return current


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Cuts the lineage, survives the loss of executors, and gives later plans the real size (so
    that small sides broadcast) and column pruning. ``options`` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = work_dir(spark, "settled")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_in_order(df: DataFrame) -> DataFrame:
    """The same by a checkpoint, which keeps partitions and the order of rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
