"""Monthly counts and shares of categories and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import catalog
from trendloom.operators.ranking import first_per_group
from trendloom.schemas import DISTRIBUTED, PREDICTED, TRAINED

MONTH = ["year", "month"]


def _months(paper: DataFrame) -> DataFrame:
    return paper.select(
        F.col("id").alias("paper_id"),
        F.col("creation_year").alias("year"),
        F.col("creation_month").alias("month"),
    )


def month_totals(paper: DataFrame) -> DataFrame:
    return _months(paper).groupBy(*MONTH).agg(F.count("*").alias("total"))


def month_share(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the share of all papers of the month, in percent."""
    percent = F.col("paper_count") * 100 / F.col("total")
    return counts.join(totals, MONTH).withColumn("total_percent", percent).drop("total")


def category_stats(paper: DataFrame, paper_categories: DataFrame) -> DataFrame:
    """Papers per category and month. Counting is by partial sums, so a hot category is no matter."""
    counts = (
        paper_categories.join(_months(paper), "paper_id")
        .groupBy("category_id", *MONTH)
        .agg(F.count("*").alias("paper_count"))
    )
    return month_share(counts, month_totals(paper)).select(
        "category_id", *MONTH, "paper_count", "total_percent",
        F.lit(0.0).alias("parent_percent"),
    )


def topic_stats(paper: DataFrame, paper_topics: DataFrame) -> DataFrame:
    """Papers per topic and month in two variants from one scan.

    Variant 1 leaves distributed assignments out (months with none have no row), variant 2
    counts all.
    """
    counts = (
        paper_topics.join(_months(paper), "paper_id")
        .groupBy("topic_id", *MONTH)
        .agg(
            F.count_if(F.col("transformed") < DISTRIBUTED).alias("_sure"),
            F.count("*").alias("_all"),
        )
    )
    variants = counts.select(
        "topic_id",
        *MONTH,
        F.inline(
            F.array(
                F.struct(F.lit(PREDICTED).alias("transformed"), F.col("_sure").alias("paper_count")),
                F.struct(F.lit(DISTRIBUTED).alias("transformed"), F.col("_all").alias("paper_count")),
            )
        ),
    ).filter(F.col("paper_count") > 0)
    return month_share(variants, month_totals(paper)).select(
        "topic_id", *MONTH, "transformed", "paper_count", "total_percent",
        F.lit(None).cast("double").alias("parent_percent"),
    )


def category_stats_by_month(stats: DataFrame, category: DataFrame) -> DataFrame:
    names = category.select(
        F.col("id").alias("category_id"), F.col("archive").alias("parent"), F.col("name").alias("label")
    )
    return (
        stats.filter(F.col("month").isNotNull())
        .join(names, "category_id")
        .select(
            F.col("category_id").alias("id"),
            "parent",
            "label",
            scalars.publication(F.col("year"), F.col("month")).alias("publication"),
            "paper_count",
            scalars.share(F.col("total_percent")).alias("total_percent"),
            F.lit(0.0).alias("parent_percent"),
        )
    )


def top_topics_by_peak(stats: DataFrame, topic: DataFrame, hierarchy: int = 0, n: int = 100) -> DataFrame:
    """The ``n`` topics of a level with the highest share in any month and variant.

    The outlier topic takes part: it may take one of the places.
    """
    level = topic.filter(F.col("hierarchy") == hierarchy).select(F.col("id").alias("topic_id"))
    return (
        stats.join(level, "topic_id", "left_semi")
        .groupBy("topic_id")
        .agg(F.max("total_percent").alias("peak"))
        .orderBy(F.desc("peak"), F.asc("topic_id"))
        .limit(n)
    )


def topic_stats_by_month(
    stats: DataFrame, topic: DataFrame, hierarchy: int = 0, n: int = 100, approximation: bool = False
) -> DataFrame:
    """Monthly series of the top topics in one variant, outlier topic left out at the end."""
    variant = DISTRIBUTED if approximation else PREDICTED
    top = top_topics_by_peak(stats, topic, hierarchy, n)
    names = topic.filter(catalog.is_topic()).select(
        F.col("id").alias("topic_id"), F.col("parent_id").alias("parent"), F.col("llm_label").alias("label")
    )
    return (
        stats.filter((F.col("transformed") == variant) & F.col("month").isNotNull())
        .join(top, "topic_id", "left_semi")
        .join(names, "topic_id")
        .select(
            F.col("topic_id").alias("id"),
            "parent",
            "label",
            scalars.publication(F.col("year"), F.col("month")).alias("publication"),
            "paper_count",
            scalars.share(F.col("total_percent")).alias("total_percent"),
            scalars.share(F.col("parent_percent")).alias("parent_percent"),
        )
    )


def _in_month(paper: DataFrame, year: int, month: int) -> Column:
    return (paper["creation_year"] == year) & (paper["creation_month"] == month)


def representative_papers_topic(
    paper: DataFrame, paper_topics: DataFrame, topic_id: int, year: int, month: int,
    n: int = 6, approximation: bool = False,
) -> DataFrame:
    """The surest papers of a topic in a month whose title holds no formula."""
    variant = DISTRIBUTED if approximation else TRAINED
    links = paper_topics.filter(
        (F.col("topic_id") == topic_id) & (F.col("transformed") == variant)
    ).select(F.col("paper_id").alias("id"), "probability")
    papers = catalog.title_without_formula(paper.filter(_in_month(paper, year, month)))
    return (
        papers.join(links, "id")
        .orderBy(F.desc("probability"), F.asc("id"))
        .limit(n)
        .select("id", "source_id", "title", "probability")
    )


def representative_papers_by_topic(
    paper: DataFrame, paper_topics: DataFrame, n: int = 6, approximation: bool = False
) -> DataFrame:
    """The same for every topic and month at once."""
    variant = DISTRIBUTED if approximation else TRAINED
    links = paper_topics.filter(F.col("transformed") == variant).select(
        F.col("paper_id").alias("id"), "topic_id", "probability"
    )
    rows = catalog.title_without_formula(paper).join(links, "id").select(
        "topic_id", F.col("creation_year").alias("year"), F.col("creation_month").alias("month"),
        "id", "source_id", "title", "probability",
    )
    return first_per_group(rows, ["topic_id", *MONTH], [F.desc("probability"), F.asc("id")], n)


def representative_papers_category(
    paper: DataFrame, paper_categories: DataFrame, category_id: int, year: int, month: int, n: int = 6
) -> DataFrame:
    links = paper_categories.filter(F.col("category_id") == category_id).select(
        F.col("paper_id").alias("id")
    )
    papers = catalog.title_without_formula(paper.filter(_in_month(paper, year, month)))
    return papers.join(links, "id").orderBy("id").limit(n).select("id", "source_id", "title")


def representative_papers_by_category(
    paper: DataFrame, paper_categories: DataFrame, n: int = 6
) -> DataFrame:
    links = paper_categories.select(F.col("paper_id").alias("id"), "category_id")
    rows = catalog.title_without_formula(paper).join(links, "id").select(
        "category_id", F.col("creation_year").alias("year"), F.col("creation_month").alias("month"),
        "id", "source_id", "title",
    )
    return first_per_group(rows, ["category_id", *MONTH], [F.asc("id")], n)
