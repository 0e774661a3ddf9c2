"""Training selections: a percentage of each group, best rows first.

Groups (an archive, a year, a topic) may hold a third of all papers, so the rank within a group
comes from sorted positions instead of a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import catalog
from trendloom.operators.ranking import rank_in_groups
from trendloom.schemas import OUTLIER


def _quota(count: Column, percent: int) -> Column:
    return F.floor(count * percent / 100)


def _top_percent(
    rows: DataFrame, group: str, sizes: DataFrame, order: list[Column], percent: int
) -> DataFrame:
    """Of each group, as many first rows as ``percent`` of its size; all outside 0 < percent < 100."""
    if not 0 < percent < 100:
        return rows
    ranked = rank_in_groups(rows, [group], order)
    return (
        ranked.join(sizes, group)
        .filter(F.col("rank") <= _quota(F.col("group_size"), percent))
        .select(*rows.columns)
    )


def sample_by_archive(
    paper: DataFrame, paper_categories: DataFrame, category: DataFrame, percent: int
) -> DataFrame:
    """Ids of the longest abstracts of each archive; a paper listed twice takes two places."""
    rows = (
        paper_categories.join(
            category.select(F.col("id").alias("category_id"), "archive"), "category_id"
        )
        .join(paper.select(F.col("id").alias("paper_id"), "abstract_length"), "paper_id")
        .select("paper_id", "category_id", "archive", "abstract_length")
    )
    sizes = catalog.archives(category).withColumnRenamed("paper_count", "group_size")
    order = [F.desc("abstract_length"), F.asc("paper_id"), F.asc("category_id")]
    picked = _top_percent(rows, "archive", sizes, order, percent)
    return picked.select(F.col("paper_id").alias("id")).distinct()


def sample_outliers_by_year(
    paper: DataFrame, paper_topics: DataFrame, topic: DataFrame, hierarchy: int, percent: int
) -> DataFrame:
    """Ids of the longest outliers of each year, by a share of all papers of that year."""
    rows = catalog.outlier_papers(paper, paper_topics, topic, hierarchy).select(
        "id", "creation_year", "abstract_length"
    )
    sizes = papers_per_year(paper).withColumnRenamed("paper_count", "group_size")
    order = [F.desc("abstract_length"), F.asc("id")]
    return _top_percent(rows, "creation_year", sizes, order, percent).select("id")


def papers_per_year(paper: DataFrame) -> DataFrame:
    return paper.groupBy("creation_year").agg(F.count("*").alias("paper_count"))


def sample_by_topic(
    paper_topics: DataFrame, topic: DataFrame, hierarchy: int, percent: int
) -> DataFrame:
    """(id, topic_id): the surest papers of each topic with their seed label.

    The label is the topic, or -1 for a paper that belongs to several topics of the level.
    """
    links = paper_topics.join(
        catalog.topics_at(topic, hierarchy), "topic_id", "left_semi"
    ).select("paper_id", "topic_id", "probability")
    sizes = topic.select(F.col("id").alias("topic_id"), F.col("paper_count").alias("group_size"))
    order = [F.desc("probability"), F.asc("paper_id")]
    picked = _top_percent(links, "topic_id", sizes, order, percent)
    several = catalog.multi_topic_papers(paper_topics, topic, hierarchy)
    # a paper has several rows here only if it has several topics; then every row carries -1
    return (
        picked.groupBy(F.col("paper_id").alias("id"))
        .agg(F.min("topic_id").alias("_topic"))
        .join(several.select(F.col("paper_id").alias("id"), "topics"), "id", "left")
        .select(
            "id",
            F.when(F.col("topics").isNotNull(), F.lit(OUTLIER).cast("bigint"))
            .otherwise(F.col("_topic"))
            .alias("topic_id"),
        )
    )


def papers_for_training(
    paper: DataFrame,
    paper_categories: DataFrame,
    category: DataFrame,
    paper_topics: DataFrame,
    topic: DataFrame,
    how: str | None = None,
    hierarchy: int = -1,
    percent: int = 100,
) -> DataFrame:
    """Selected papers; ``how`` is None (all with an embedding), archives, outliers or hierarchy."""
    if how is None or how == "None":
        return catalog.all_trainable(paper)
    if how == "archives":
        picked = sample_by_archive(paper, paper_categories, category, percent)
    elif how == "outliers":
        picked = sample_outliers_by_year(paper, paper_topics, topic, hierarchy, percent)
    elif how == "hierarchy":
        picked = sample_by_topic(paper_topics, topic, hierarchy, percent)
    else:
        raise ValueError(f"unknown selection: {how}")
    return paper.join(picked, "id")
