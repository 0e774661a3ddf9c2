"""Papers, categories and topics: links between them and look-ups over them.

Dimension sides (categories, topics, monthly totals) carry no broadcast hint: Spark broadcasts
them below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle, where
adaptive execution splits a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators.ranking import dedup_by_key
from trendloom.schemas import OUTLIER, TRAINED


def is_topic() -> Column:
    return F.col("orig_id") != OUTLIER


def topics_at(topic: DataFrame, hierarchy: int) -> DataFrame:
    """Ids of the proper topics of a hierarchy level."""
    return topic.filter((F.col("hierarchy") == hierarchy) & is_topic()).select(
        F.col("id").alias("topic_id")
    )


def distinct_categories(papers: DataFrame) -> DataFrame:
    return (
        papers.select(F.explode("categories").alias("name"))
        .filter(F.col("name").isNotNull() & (F.col("name") != ""))
        .distinct()
        .select(scalars.archive_of(F.col("name")).alias("archive"), "name")
    )


def link_paper_categories(papers: DataFrame, category: DataFrame) -> DataFrame:
    """(paper_id, category_id, is_primary) for papers with ``id`` and ``categories``.

    A code listed twice by a paper links once, as primary if it is listed first.
    """
    codes = papers.select(F.col("id").alias("paper_id"), F.posexplode("categories").alias("_pos", "name"))
    return (
        codes.join(category.select("name", F.col("id").alias("category_id")), "name")
        .groupBy("paper_id", "category_id")
        .agg(F.max((F.col("_pos") == 0).cast("int")).alias("is_primary"))
    )


def archives(category: DataFrame) -> DataFrame:
    """Papers per archive; a paper counts once per category of the archive."""
    return category.groupBy("archive").agg(F.sum("paper_count").alias("paper_count"))


def count_into(table: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Set ``paper_count`` of a category or topic table from its link table; none counts 0."""
    counts = links.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("_n"))
    return (
        table.drop("paper_count")
        .join(counts, "id", "left")
        .select(
            *(c for c in table.columns if c != "paper_count"),
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("paper_count"),
        )
        .select(*table.columns)
    )


def category_paper_count(category: DataFrame, paper_categories: DataFrame) -> DataFrame:
    return count_into(category, paper_categories, "category_id")


def topic_paper_count(topic: DataFrame, paper_topics: DataFrame) -> DataFrame:
    return count_into(topic, paper_topics, "topic_id")


def subset_map(category: DataFrame, archive_max: int, category_min: int) -> DataFrame:
    """Each category with the subset it trains in: itself if large in a large archive, else its archive."""
    totals = archives(category).withColumnRenamed("paper_count", "_archive_count")
    own = (
        (F.col("name") != F.col("archive"))
        & (F.col("_archive_count") > archive_max)
        & (F.col("paper_count") > category_min)
    )
    return category.join(totals, "archive").select(
        F.col("id").alias("category_id"),
        F.when(own, F.col("name")).otherwise(F.col("archive")).alias("subset"),
    )


def papers_by_categories(
    paper: DataFrame, paper_categories: DataFrame, category_ids: DataFrame
) -> DataFrame:
    """Papers with an embedding in any of the given categories (column ``category_id``)."""
    wanted = paper_categories.join(category_ids, "category_id", "left_semi").select(
        F.col("paper_id").alias("id")
    )
    return paper.filter(F.col("embedding").isNotNull()).join(wanted, "id", "left_semi")


def papers_without_embedding(paper: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers still to embed: all of them, or the ``limit`` with the lowest ids."""
    todo = paper.filter(F.col("embedding").isNull())
    return todo if limit is None else todo.orderBy("id").limit(limit)


def all_trainable(paper: DataFrame) -> DataFrame:
    return paper.filter(F.col("embedding").isNotNull())


def title_without_formula(papers: DataFrame) -> DataFrame:
    return papers.filter(~F.col("title").ilike("%(formula)%"))


def outlier_papers(
    paper: DataFrame, paper_topics: DataFrame, topic: DataFrame, hierarchy: int
) -> DataFrame:
    """Papers in no proper topic of a hierarchy level."""
    held = paper_topics.join(topics_at(topic, hierarchy), "topic_id", "left_semi")
    return paper.join(held.select(F.col("paper_id").alias("id")), "id", "left_anti")


def model_links(paper_topics: DataFrame, topic: DataFrame, model: str) -> DataFrame:
    """Assignments to the topics of a model, with ``orig_id``."""
    own = topic.filter(F.col("model") == model).select(F.col("id").alias("topic_id"), "orig_id")
    return paper_topics.join(own, "topic_id")


def papers_missing_in_model(
    paper: DataFrame, paper_topics: DataFrame, topic: DataFrame, model: str,
    limit: int | None = None,
) -> DataFrame:
    held = model_links(paper_topics, topic, model).select(F.col("paper_id").alias("id"))
    missing = paper.join(held, "id", "left_anti")
    return missing if limit is None else missing.orderBy("id").limit(limit)


def papers_by_model(
    paper: DataFrame, paper_topics: DataFrame, topic: DataFrame, model: str
) -> DataFrame:
    """Papers a model was trained on, with their topic."""
    trained = model_links(paper_topics, topic, model).filter(F.col("transformed") == TRAINED)
    return paper.join(
        trained.select(F.col("paper_id").alias("id"), "topic_id", "orig_id"), "id"
    )


def papers_of_unlabelled_topics(
    paper: DataFrame, paper_topics: DataFrame, topic: DataFrame
) -> DataFrame:
    bare = topic.filter(F.col("llm_label") == "").select(
        F.col("id").alias("topic_id"), "model", "orig_id"
    )
    links = paper_topics.join(bare, "topic_id").select(
        "model", F.col("orig_id").alias("topic_id"), F.col("paper_id").alias("id")
    )
    return links.join(paper, "id")


def resolve_topics(assignments: DataFrame, topic: DataFrame, model: str) -> DataFrame:
    """Replace model-local topic ids by the ids of the topic table."""
    own = topic.filter(F.col("model") == model).select(
        F.col("id").alias("_row_id"), F.col("orig_id").alias("topic_id")
    )
    return assignments.join(own, "topic_id").select(
        *(F.col("_row_id").alias("topic_id") if c == "topic_id" else c for c in assignments.columns)
    )


def model_exists(topic: DataFrame, model: str) -> bool:
    return not topic.filter(F.col("model") == model).isEmpty()


def models_for_transform(topic: DataFrame, paper: DataFrame) -> DataFrame:
    """Models above the subset level that hold fewer assignments than there are papers."""
    total = paper.select(F.count("*").alias("n")).scalar()
    return (
        topic.filter(F.col("hierarchy") > -1)
        .groupBy("hierarchy", "model")
        .agg(F.sum("paper_count").alias("assigned"))
        .filter(F.col("assigned") < total)
        .select("hierarchy", "model")
    )


def multi_topic_papers(paper_topics: DataFrame, topic: DataFrame, hierarchy: int) -> DataFrame:
    """Papers in more than one proper topic of a level."""
    return (
        paper_topics.join(topics_at(topic, hierarchy), "topic_id", "left_semi")
        .groupBy("paper_id")
        .agg(F.count("*").alias("topics"))
        .filter(F.col("topics") > 1)
    )


def parent_topic(
    paper_topics: DataFrame, topic: DataFrame, model: str, parent_model: str
) -> DataFrame:
    """(child_id, parent_id): the parent topic that shares most papers, the lower id on a tie.

    Assignments of both models meet on the paper, a fine key: a paper has a handful of topics.
    """
    child = model_links(paper_topics, topic, model).filter(is_topic())
    parent = model_links(paper_topics, topic, parent_model)
    shared = (
        child.select("paper_id", F.col("topic_id").alias("child_id"))
        .join(parent.select("paper_id", F.col("topic_id").alias("parent_id")), "paper_id")
        .groupBy("child_id", "parent_id")
        .agg(F.count("*").alias("papers"))
    )
    return dedup_by_key(shared, ["child_id"], [F.desc("papers"), F.asc("parent_id")])


def outlier_label(topic: DataFrame, taxonomy: DataFrame, default: str = "Outliers") -> DataFrame:
    """Label each model's outlier topic after its subset (``subset_<code>``) in the taxonomy."""
    codes = taxonomy.select(
        F.concat(F.lit("subset_"), "code").alias("model"), F.col("name").alias("_taxon")
    )
    label = F.when(
        F.col("orig_id") == OUTLIER, F.coalesce("_taxon", F.lit(default))
    ).otherwise(F.col("llm_label"))
    return (
        topic.join(codes, "model", "left")
        .withColumn("llm_label", label)
        .select(*topic.columns)
    )


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined
