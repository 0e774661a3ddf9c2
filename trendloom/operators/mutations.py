"""New versions of tables: inserts that skip known keys, updates, deletes with their cascades.

Parquet has no MERGE, so each operator takes the current tables and returns the new ones;
``sources.tables`` writes them beside the old version and switches over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import catalog
from trendloom.operators.ranking import dedup_by_key, with_position
from trendloom.session import settle, tasks_for
from trendloom.schemas import DISTRIBUTED, KEYS, PREDICTED, TRAINED


def insert_or_ignore(
    target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """``target`` plus the rows whose key it lacks; of several new rows the first in order stays."""
    return target.unionByName(new_rows(target, rows, key, order), allowMissingColumns=True)


def new_rows(
    target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """The rows whose key ``target`` lacks, one per key; both sides are dealt into ``tasks`` if given."""
    if tasks:
        rows, target = (f.repartition(tasks, *key) for f in (rows, target.select(*key)))
    order = order or [F.asc(c) for c in rows.columns if c not in key]
    fresh = dedup_by_key(rows, key, order or [F.asc(c) for c in key])
    return fresh.join(target.select(*key), list(key), "left_anti").select(*rows.columns)


def assign_ids(target: DataFrame, rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Give rows without ``id`` the numbers after the highest one of ``target``."""
    top = target.select(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    placed = with_position(rows, order, "id")
    return placed.select(
        (F.col("id") + 1 + top).alias("id"), *(c for c in rows.columns if c != "id")
    )


def update_embeddings(paper: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Set ``embedding`` from (id, embedding); papers not listed keep theirs."""
    fresh = embeddings.select("id", F.col("embedding").alias("_new"))
    return (
        paper.join(fresh, "id", "left")
        .withColumn("embedding", F.coalesce("_new", "embedding"))
        .select(*paper.columns)
    )


def update_labels(topic: DataFrame, labels: DataFrame, model: str) -> DataFrame:
    """Set labels from (topic_id, llm_label), where topic_id is local to the model."""
    fresh = labels.select(
        F.lit(model).alias("model"),
        F.col("topic_id").cast("int").alias("orig_id"),
        F.col("llm_label").alias("_new"),
    )
    return (
        topic.join(fresh, ["model", "orig_id"], "left")
        .withColumn("llm_label", F.coalesce("_new", "llm_label"))
        .select(*topic.columns)
    )


def excl_outliers(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("topic_id") != -1)


def import_topics(
    topic: DataFrame,
    paper_topics: DataFrame,
    hierarchy: int,
    model: str,
    topics: DataFrame,
    assignments: DataFrame,
    without_outliers: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Store a new model: topics (topic_id, name, llm_label) and (paper_id, topic_id, probability)."""
    described = topics.select(
        F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(hierarchy).alias("hierarchy"),
        F.lit(model).alias("model"),
        F.col("topic_id").cast("int").alias("orig_id"),
        "name",
        "llm_label",
        F.lit(0).cast("bigint").alias("paper_count"),
    )
    added = new_rows(topic, described, KEYS["topic"])
    all_topics = topic.unionByName(assign_ids(topic, added, [F.asc("orig_id")]))
    rows = excl_outliers(assignments) if without_outliers else assignments
    return _import_links(all_topics, paper_topics, model, rows, TRAINED)


def import_models(
    topic: DataFrame, paper_topics: DataFrame, hierarchy: int, topics: DataFrame, assignments: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Store several new models at once: ``import_topics`` with a ``model`` beside each topic and
    assignment. Only the counts of the models' topics are worked out."""
    described = topics.select(
        F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(hierarchy).alias("hierarchy"),
        "model",
        F.col("topic_id").cast("int").alias("orig_id"),
        "name",
        "llm_label",
    )
    fresh = new_rows(topic, described, KEYS["topic"])
    added = settle(assign_ids(topic, fresh, [F.asc("model"), F.asc("orig_id")]))
    own = added.select("model", F.col("orig_id").alias("topic_id"), F.col("id").alias("_row_id"))
    links = settle(
        dedup_by_key(
            assignments.join(own, ["model", "topic_id"]).select(
                "paper_id", F.col("_row_id").alias("topic_id"), "probability", F.lit(TRAINED).alias("transformed")
            ),
            KEYS["paper_topics"],
            [F.desc("probability")],
        )
    )
    counts = links.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("paper_count"))
    counted = added.join(counts, "id", "left").withColumn("paper_count", F.coalesce("paper_count", F.lit(0).cast("bigint")))
    return topic.unionByName(counted.select(*topic.columns)), paper_topics.unionByName(links.select(*paper_topics.columns))


def import_assignments(
    topic: DataFrame, paper_topics: DataFrame, model: str, assignments: DataFrame,
    distributed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Add predicted or distributed assignments to an existing model; known pairs stay as they are."""
    return _import_links(
        topic, paper_topics, model, assignments, DISTRIBUTED if distributed else PREDICTED
    )


def _new_links(paper_topics: DataFrame, links: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``new_rows`` for links; both are stored, so that counting them reads no rows."""
    tasks = tasks_for(links.sparkSession, max(paper_topics.count(), links.count()))
    return new_rows(paper_topics, links, KEYS["paper_topics"], order, tasks)


def _import_links(
    topic: DataFrame, paper_topics: DataFrame, model: str, assignments: DataFrame, transformed: int
) -> tuple[DataFrame, DataFrame]:
    links = catalog.resolve_topics(assignments, topic, model).select(
        "paper_id", "topic_id", "probability", F.lit(transformed).alias("transformed")
    )
    # settled, as the links are counted here and written by the caller
    fresh = settle(_new_links(paper_topics, settle(links), [F.desc("probability")]))
    merged = paper_topics.unionByName(fresh, allowMissingColumns=True)
    return catalog.topic_paper_count(topic, merged), merged


def update_hierarchy(
    topic: DataFrame, paper_topics: DataFrame, model: str, parent_model: str
) -> tuple[DataFrame, DataFrame]:
    """Put a model below its parent model and copy its assignments to the parent topics.

    Of several assignments of a paper that lead to one parent the surest is copied.
    """
    # links of a paper meet in tasks of bounded size
    dealt = paper_topics.repartition(tasks_for(topic.sparkSession, paper_topics.count()), "paper_id")
    parent = catalog.parent_topic(dealt, topic, model, parent_model)
    # settled, as topics and links follow from it, and as links are counted here and written after
    found = settle(parent.select(F.col("child_id").alias("id"), F.col("parent_id").alias("_parent")))
    mine = (F.col("model") == model) & catalog.is_topic()
    linked = (
        topic.join(found, "id", "left")
        .withColumn("parent_id", F.when(mine, F.col("_parent")).otherwise(F.col("parent_id")))
        .select(*topic.columns)
    )
    parents = linked.filter((F.col("model") == model) & F.col("parent_id").isNotNull()).select(
        F.col("id").alias("topic_id"), F.col("parent_id").alias("_up")
    )
    copies = paper_topics.join(parents, "topic_id").select(
        "paper_id", F.col("_up").alias("topic_id"), "probability", "transformed"
    )
    order = [F.desc("probability"), F.asc("transformed")]
    fresh = settle(_new_links(paper_topics, settle(copies), order))
    merged = paper_topics.unionByName(fresh, allowMissingColumns=True)
    return catalog.topic_paper_count(linked, merged), merged


def delete_model(
    topic: DataFrame, paper_topics: DataFrame, topic_stats: DataFrame, model: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop a model's topics with their assignments and stats; their children lose the parent."""
    gone = topic.filter(F.col("model") == model).select(F.col("id").alias("topic_id"))
    kept = topic.filter(F.col("model") != model)
    orphaned = kept.join(
        gone.select(F.col("topic_id").alias("parent_id"), F.lit(True).alias("_gone")),
        "parent_id",
        "left",
    ).withColumn("parent_id", F.when(F.col("_gone").isNull(), F.col("parent_id")))
    return (
        orphaned.select(*topic.columns),
        paper_topics.join(gone, "topic_id", "left_anti").select(*paper_topics.columns),
        topic_stats.join(gone, "topic_id", "left_anti").select(*topic_stats.columns),
    )


def paper_additions(
    paper: DataFrame,
    category: DataFrame,
    paper_categories: DataFrame,
    papers: DataFrame,
    recount: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What imported papers (see ``ingest.imported_papers``) add: papers, categories, links.

    New papers and new links are rows to append; the categories are the whole new version. Those
    the import names are counted anew over all links, or with ``recount`` off the new links are
    added to their stored counts. Of the stored tables only keys and ids are read, and only those
    of imported papers go on. A known paper keeps its stored text but gains categories it newly
    lists; links are unique.
    """
    papers = settle(papers)  # cleaned once, read for papers, categories and links
    order = [F.asc("update_date"), F.asc("title"), F.asc("abstract")]
    # the batch is the small side of both semi joins, so the stored keys need no shuffle
    known = settle(paper.select("id", "source_id").join(papers, "source_id", "left_semi"))
    added = settle(new_rows(known, papers.drop("categories"), KEYS["paper"], order))
    numbers = settle(assign_ids(paper, added.select("source_id"), [F.asc("source_id")]))
    names = catalog.distinct_categories(papers).withColumn("paper_count", F.lit(0).cast("bigint"))
    fresh = new_rows(category, names, KEYS["category"])
    categories = settle(category.unionByName(assign_ids(category, fresh, [F.asc("name")])))
    ids = known.unionByName(numbers.select("id", "source_id"))
    listed = papers.select("source_id", "categories").join(ids, "source_id")
    named = settle(catalog.link_paper_categories(listed, categories))
    stored = paper_categories.join(known.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    links = settle(new_rows(stored, named, KEYS["paper_categories"], [F.desc("is_primary")]))
    if recount:
        touched = named.select("category_id").distinct()
        every = paper_categories.select("category_id").unionByName(links.select("category_id"))
        counted = every.join(touched, "category_id", "left_semi")
        before = F.lit(0)
    else:
        counted = links
        before = F.coalesce("paper_count", F.lit(0))
    counts = counted.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("_count"))
    result = categories.join(counts, "id", "left").withColumn(
        "paper_count", F.coalesce(F.col("_count") + before, "paper_count")
    )
    return added.join(numbers, "source_id"), result.select(*category.columns), links


def import_papers(
    paper: DataFrame, category: DataFrame, paper_categories: DataFrame, papers: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The paper, category and link tables after an import."""
    added, categories, links = paper_additions(paper, category, paper_categories, papers)
    return (
        paper.unionByName(added, allowMissingColumns=True),
        categories,
        paper_categories.unionByName(links),
    )
