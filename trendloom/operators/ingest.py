"""From raw records to clean papers, with a report of what was dropped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scalars, text

FIRST_MARK = "1990-01-01"  # fixed value: the mark before anything was read

# Stages in which a record may be dropped, in order.
WITHDRAWN, SHORT, UNTRIMMABLE, IMPORTED = "withdrawn", "short", "untrimmable", "imported"


def with_creation(records: DataFrame) -> DataFrame:
    created = scalars.creation_date(F.col("versions"))
    return (
        records.withColumn("creation_date", created)
        .withColumn("creation_year", F.year("creation_date"))
        .withColumn("creation_month", F.month("creation_date"))
    )


def filter_since(records: DataFrame, year_min: int, last_update: str = FIRST_MARK) -> DataFrame:
    """Records created from ``year_min`` on and updated after the mark; undated ones go."""
    return records.filter(
        (F.col("creation_year") >= year_min)
        & (F.col("update_date").cast("date") > F.lit(last_update).cast("date"))
    )


def high_water_mark(records: DataFrame) -> DataFrame:
    """The latest update date of all records, filtered or not."""
    return records.agg(
        F.coalesce(
            F.max(F.col("update_date").cast("date")), F.lit(FIRST_MARK).cast("date")
        ).alias("update_date")
    )


def clean(records: DataFrame) -> DataFrame:
    """Clean title and abstract; white space at the ends stays for the withdrawn test."""
    return records.withColumns(
        {c: text.clean_text(text.clean_accents(F.col(c))) for c in ("title", "abstract")}
    )


def filter_withdrawn(records: DataFrame) -> DataFrame:
    return records.filter(~text.is_withdrawn(F.col("abstract")))


def filter_short(records: DataFrame) -> DataFrame:
    return records.filter(F.length("abstract") >= text.MIN_LENGTH)


def trim(records: DataFrame) -> DataFrame:
    trimmed = text.trim_sentences(text.split_sentences(F.col("abstract")))
    return records.withColumn("abstract", trimmed).withColumn(
        "abstract_length", F.length("abstract")
    )


def filter_untrimmable(records: DataFrame) -> DataFrame:
    return records.filter(F.col("abstract_length") <= text.MAX_LENGTH)


def staged(records: DataFrame) -> DataFrame:
    """Cleaned and trimmed records with the ``stage`` each of them ended in.

    A record without an abstract ends as a short one.
    """
    cleaned = clean(records).withColumn(
        "_early",
        F.when(text.is_withdrawn(F.col("abstract")), WITHDRAWN).when(
            F.coalesce(F.length("abstract"), F.lit(0)) < text.MIN_LENGTH, SHORT
        ),
    )
    return (
        trim(cleaned)
        .withColumn(
            "stage",
            F.coalesce(
                "_early",
                F.when(F.col("abstract_length") > text.MAX_LENGTH, UNTRIMMABLE),
                F.lit(IMPORTED),
            ),
        )
        .drop("_early")
    )


def import_report(stages: DataFrame) -> DataFrame:
    """One row of counters; each record counts at the first stage that dropped it."""

    def tally(stage: str) -> Column:
        return F.count_if(F.col("stage") == stage).alias(stage)

    return stages.agg(
        F.count("*").alias("total"),
        *(tally(s) for s in (IMPORTED, WITHDRAWN, SHORT, UNTRIMMABLE)),
    )


def imported_papers(stages: DataFrame) -> DataFrame:
    """What is kept, in the shape of the paper table without ids, plus the category codes."""
    return stages.filter(F.col("stage") == IMPORTED).select(
        F.col("id").alias("source_id"),
        "creation_year",
        "creation_month",
        "title",
        "abstract",
        "abstract_length",
        F.col("update_date").cast("date").alias("update_date"),
        scalars.expand_categories(F.col("categories")).alias("categories"),
    )


def clean_snapshot(
    records: DataFrame, year_min: int = 2000, last_update: str = FIRST_MARK
) -> DataFrame:
    """Dates, incremental filter, cleaning and stages; the filter comes before any cleaning."""
    return staged(filter_since(with_creation(records), year_min, last_update))
