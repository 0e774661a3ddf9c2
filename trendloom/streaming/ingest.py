"""Incremental runs over new files: ingest once, drop repeats, keep monthly counts current."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from trendloom.operators import ingest, mutations
from trendloom.schemas import SNAPSHOT
from trendloom.session import settle
from trendloom.sources import tables


def snapshot_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder, each read once per checkpoint."""
    reader = spark.readStream.schema(SNAPSHOT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def store_batch(batch: DataFrame, root: str, key: str, mark: str, year_min: int = 2000) -> None:
    """Store the papers of one batch with their categories, and the highest date.

    The batch notes what it starts from, and all it writes has a place of its own. So it may run
    again under its key, with whatever part of its writes done, and leaves the same tables.
    """
    session = batch.sparkSession
    batch = settle(batch)  # the batch is read for the papers and for the mark
    begun = tables.begin_batch(session, root, key, mark)
    papers = ingest.imported_papers(ingest.clean_snapshot(batch, year_min, begun["mark"]))
    paper, links = (tables.read_table(session, root, t, without=key) for t in ("paper", "paper_categories"))
    category = tables.read_table(session, root, "category", version=begun["category_version"])
    added, categories, named = mutations.paper_additions(paper, category, links, papers, recount=False)
    # papers and links only grow; the small category table is written anew
    tables.add_rows(added, root, "paper", key)
    tables.add_rows(named, root, "paper_categories", key)
    tables.write_table(categories, root, "category", version=begun["category_version"] + 1)
    so_far = session.createDataFrame([(tables.read_mark(session, root, ingest.FIRST_MARK),)], "u string")
    latest = ingest.high_water_mark(batch).unionByName(
        so_far.select(F.col("u").cast("date").alias("update_date"))
    )
    highest = settle(latest.agg(F.max("update_date").alias("update_date")))
    tables.write_mark(highest, root, begun["mark_version"] + 1)


def stream_ingest(
    records: DataFrame, root: str, checkpoint: str, year_min: int = 2000
) -> StreamingQuery:
    """Clean what arrives and store new papers with their categories; stops when all is read.

    A record not newer than the stored mark of an earlier run is late and dropped; a batch that is
    run again after a failure keeps the mark of its first run. One stream at a time may write to
    the tables of ``root``.
    """
    mark = tables.read_mark(records.sparkSession, root, ingest.FIRST_MARK)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, number: int) -> None:
        store_batch(batch, root, f"{stream}-{number}", mark, year_min)

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedup(
    records: DataFrame, path: str, checkpoint: str, key: str = "id", lifetime: str = "1 day"
) -> StreamingQuery:
    """Write the first record of each key to ``path``; ``unique_records`` reads them.

    Keys are state of the stream for ``lifetime`` after their arrival, so the state holds the keys
    of that time only. A key that returns later is found among the stored ones. A null key is a key
    like others; a batch that runs again writes over its own folder.
    """
    names = records.columns
    arrived = records.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", lifetime)
    recent = arrived.dropDuplicatesWithinWatermark([key]).select(*names)

    def store(batch: DataFrame, number: int) -> None:
        stored = _unique(batch.sparkSession, path, batch.schema).filter(F.col("b") < number)
        keys = stored.select(F.col(key).alias("_key"))
        fresh = batch.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/b={number}")

    return (
        recent.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _unique(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the batches before wrote, with the number ``b`` of the batch; none before the first."""
    batches = StructType([*schema.fields, StructField("b", LongType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/b=-1")
    return spark.read.schema(batches).parquet(path)


def unique_records(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``stream_dedup`` has kept."""
    return spark.read.parquet(path).drop("b")


def month_counts(papers: DataFrame) -> DataFrame:
    """Counts per category and month over a stream (or table) of papers with categories."""
    return (
        papers.select("creation_year", "creation_month", F.explode("categories").alias("category"))
        .groupBy("category", "creation_year", "creation_month")
        .agg(F.count("*").alias("paper_count"))
    )


def stream_month_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed counts of each batch beside those before; ``current_counts`` reads them.

    A batch that runs again writes over its own folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    return (
        counts.writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of each category and month."""
    written = spark.read.parquet(path)
    keys = [c for c in written.columns if c not in ("paper_count", "batch", "b")]
    return written.groupBy(*keys).agg(F.max_by("paper_count", "batch").alias("paper_count"))
