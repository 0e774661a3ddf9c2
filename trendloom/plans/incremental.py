"""Queries that run as streams over files made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import ingest
from trendloom.plans import cleaning, views  # noqa: F401  (its views are used)
from trendloom.plans.registry import query
from trendloom.session import work_dir
from trendloom.sources import tables
from trendloom.streaming import ingest as streams


def _files(spark: SparkSession, sf: str, copies: int = 1) -> str:
    """Snapshot records as JSON files, each record ``copies`` times."""
    path = work_dir(spark, "arrivals")
    records = views.snapshot(spark, sf)
    for _ in range(copies):
        records.write.mode("append").json(path)
    return path


@query("""SELECT id AS source_id, title, abstract_length, update_date FROM stages WHERE stage = 'imported'""", "stages")
def stream_ingest(spark, sf):
    """Records not newer than the mark of an earlier run are late."""
    root = work_dir(spark, "store")
    mark = spark.range(1).select(F.lit(cleaning.MARK).cast("date").alias("update_date"))
    tables.write_mark(mark, root)
    records = streams.snapshot_stream(spark, _files(spark, sf, 2), 8)
    streams.stream_ingest(records, root, work_dir(spark, "offsets")).awaitTermination()
    return tables.read_table(spark, root, "paper").select("source_id", "title", "abstract_length", "update_date")


@query("SELECT id, title FROM snapshot", "snapshot")
def stream_dedup(spark, sf):
    out = work_dir(spark, "unique")
    records = streams.snapshot_stream(spark, _files(spark, sf, 2))
    streams.stream_dedup(records, out, work_dir(spark, "offsets")).awaitTermination()
    return streams.unique_records(spark, out).select("id", "title")


@query("""SELECT cat AS category, year(creation_date)::INT AS creation_year, month(creation_date)::INT AS creation_month, count(*) AS paper_count
          FROM (SELECT creation_date, unnest(list_slice(str_split(categories, ' '), 1, 3)) AS cat FROM snapshot WHERE creation_date IS NOT NULL)
          GROUP BY ALL""", "snapshot")
def stream_month_counts(spark, sf):
    out = work_dir(spark, "counts")
    arrivals = ingest.with_creation(streams.snapshot_stream(spark, _files(spark, sf), 3))
    papers = arrivals.filter(F.col("creation_date").isNotNull()).select(
        "creation_year", "creation_month", scalars.expand_categories(F.col("categories")).alias("categories")
    )
    streams.stream_month_counts(streams.month_counts(papers), out, work_dir(spark, "offsets")).awaitTermination()
    return streams.current_counts(spark, out)
