"""Whole runs: train models on selections or subsets, assign papers, merge topics, recount."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators import catalog, clusters, hierarchy, mutations, neighbours, ranking
from trendloom.operators import topics as topic_ops
from trendloom.schemas import OUTLIER
from trendloom.session import settle


@dataclass(frozen=True)
class Settings:
    """How a model is trained. ``probes`` limits the neighbour search, None searches exactly.

    ``sweep_samples`` and ``sweep_sizes``, both ascending, replace ``min_samples`` and
    ``min_cluster_size`` by the pair with the best validity among those with ``min_clusters``; where
    no pair has as many, training fails, or, unless ``strict``, goes on with the most there are.
    """

    neighbours: int = 24
    min_samples: int = 8
    min_cluster_size: int = 256
    eps: float = 0.5
    top_words: int = 10
    keyword_diversity: float = 0.32
    min_df: int = 1
    probes: int | None = None
    binary: bool = False
    outlier_threshold: float = 1.0
    reduce_distance: float | None = None
    sweep_samples: tuple[int, ...] = ()
    sweep_sizes: tuple[int, ...] = ()
    min_clusters: int = 1
    strict: bool = True


@dataclass(frozen=True)
class Model:
    """A trained model as tables: topics to import, assignments, term weights."""

    topics: DataFrame
    assignments: DataFrame
    weights: DataFrame


def _neighbours(papers: DataFrame, settings: Settings, k: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """The nearest by the metric of the settings, among the papers themselves or ``others``."""
    from trendloom.functions.scalars import quantize_bits

    shape, search = F.col("embedding"), neighbours.knn_cosine
    if settings.binary:
        shape, search = quantize_bits(F.col("embedding")).alias("codes"), neighbours.knn_hamming
    points, base = (f if f is None else f.select("id", shape) for f in (papers, others))
    return search(points, k or settings.neighbours, base, probes=settings.probes)


def reduce_topics(docs: DataFrame, counts: DataFrame, distance: float) -> DataFrame:
    """(topic_id, new_id): topics within a distance of each other (1 − cosine) become one."""
    similar = topic_ops.topic_similarity(topic_ops.c_tf_idf(counts))
    close = similar.filter(1 - F.col("similarity") <= distance).select(
        F.col("topic_a").alias("a"), F.col("topic_b").alias("b")
    )
    proper = docs.filter(F.col("topic_id") != OUTLIER).select(F.col("topic_id").cast("bigint").alias("id")).distinct()
    together = clusters.connected_components(proper, close)
    # the lists hold topics of one model
    groups = together.groupBy(F.col("component").alias("group_id")).agg(F.collect_list("id").alias("topics"))
    return topic_ops.merge_map(topic_ops.topic_sizes(docs), groups)


def train(
    papers: DataFrame, settings: Settings, seeds: DataFrame | None = None, outlier_name: str = "Outliers"
) -> Model:
    """Cluster papers (id, abstract, embedding) and describe the clusters.

    With ``seeds`` (id, topic_id) known labels guide the clusters; papers no label reaches are
    outliers.
    """
    near = settle(_neighbours(papers, settings))
    min_samples, found = settings.min_samples, None
    if seeds is None and settings.sweep_samples and settings.sweep_sizes:
        scores, found = clusters.cluster_sweep(
            near, settings.sweep_samples, settings.sweep_sizes, settings.min_clusters, settings.eps, settings.strict
        )
        enough = settings.min_clusters if settings.strict else clusters.enough_clusters(scores, settings.min_clusters)
        min_samples, _ = clusters.best_setting(scores, enough)
    core = settle(clusters.core_distance(near, min_samples))
    if found is not None:
        pass
    elif seeds is None:
        found = clusters.density_clusters(near, settings.min_samples, settings.min_cluster_size, settings.eps)
    else:
        found = clusters.seeded_clusters(near, seeds).select("id", F.col("topic_id").alias("cluster"))
    strong = settle(clusters.membership_strength(found, core))
    sizes = strong.groupBy(F.col("cluster").alias("topic_id")).agg(F.count("*").alias("size"))
    ranks = topic_ops.rank_topics_by_size(sizes).withColumnRenamed("topic_id", "cluster")
    numbered = strong.join(ranks, "cluster").select(
        F.col("id").alias("doc_id"), F.col("new_id").alias("topic_id"), "probability"
    )
    texts = papers.select(F.col("id").alias("doc_id"), F.col("abstract").alias("text"))
    docs = settle(numbered.join(texts, "doc_id"))
    counts = settle(topic_ops.term_counts(docs))
    if settings.reduce_distance is not None:
        mapping = settle(reduce_topics(docs, counts, settings.reduce_distance))
        docs = settle(topic_ops.merge_topics(docs, mapping))
        counts = settle(topic_ops.merge_counts(counts, mapping))
    if settings.outlier_threshold < 1:
        weights = topic_ops.c_tf_idf(counts, settings.min_df)
        mix = topic_ops.approximate_distribution(docs.select("doc_id", "topic_id", "text"), weights)
        moved = topic_ops.reduce_outliers(docs, mix, settings.outlier_threshold)
        docs = settle(docs.drop("topic_id").join(moved, "doc_id"))
        counts = settle(topic_ops.term_counts(docs))
    weights = settle(topic_ops.c_tf_idf(counts, settings.min_df))
    words = topic_ops.mmr_keywords(weights, settings.top_words, settings.keyword_diversity)
    lists = topic_ops.word_lists(words, settings.top_words)
    info = topic_ops.topic_sizes(docs).join(lists, "topic_id", "left")
    from trendloom.functions.text import topic_name

    empty = F.array().cast("array<string>")
    name = topic_name(F.col("topic_id"), F.coalesce("words", empty))
    label = F.when(F.col("topic_id") == OUTLIER, F.lit(outlier_name)).otherwise(name)
    topics = info.select("topic_id", name.alias("name"), label.alias("llm_label"))
    assignments = docs.select(F.col("doc_id").alias("paper_id"), "topic_id", "probability")
    return Model(settle(topics), assignments, weights)


def train_model(
    topic: DataFrame, paper_topics: DataFrame, topic_stats: DataFrame, papers: DataFrame, model: str,
    level: int, settings: Settings, overwrite: bool = False, seeds: DataFrame | None = None,
    outlier_name: str = "Outliers", selected: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and store a model: new versions of topic, paper_topics and topic_stats.

    ``selected`` (id), from ``operators.selection``, limits the papers it is trained on.

    A model that exists stays as it is unless ``overwrite`` is set.
    """
    if catalog.model_exists(topic, model):
        if not overwrite:
            return topic, paper_topics, topic_stats
        topic, paper_topics, topic_stats = mutations.delete_model(topic, paper_topics, topic_stats, model)
    if selected is not None:
        papers = settle(papers.join(selected.select("id").distinct(), "id", "left_semi"))
    trained = train(papers, settings, seeds, outlier_name)
    topic, paper_topics = mutations.import_topics(
        topic, paper_topics, level, model, trained.topics, trained.assignments
    )
    return topic, paper_topics, topic_stats


def train_subset_models(
    paper: DataFrame, category: DataFrame, paper_categories: DataFrame, topic: DataFrame,
    paper_topics: DataFrame, topic_stats: DataFrame, archive_max: int, category_min: int, settings: Settings,
    names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One model per subset of the categories; subsets that have one are left out.

    All are trained together. Settings that change a model after its clusters are known (merged
    topics, moved outliers) or compare bits need a run per subset: subsets are few (archives and
    their largest categories), so their names pass the driver then.
    """
    if settings.reduce_distance is None and settings.outlier_threshold >= 1 and not settings.binary:
        from trendloom.plans import subsets as together

        return together.train_subset_models(
            paper, category, paper_categories, topic, paper_topics, archive_max, category_min, settings, names
        )
    subsets = settle(catalog.subset_map(category, archive_max, category_min))
    names = [row["subset"] for row in subsets.select("subset").distinct().orderBy("subset").collect()]
    for name in names:
        ids = subsets.filter(F.col("subset") == name).select("category_id")
        papers = settle(catalog.papers_by_categories(paper, paper_categories, ids))
        topic, paper_topics, topic_stats = train_model(
            topic, paper_topics, topic_stats, papers, f"subset_{name}", -1, settings, outlier_name=name
        )
        topic, paper_topics = settle(topic), settle(paper_topics)
    return topic, paper_topics


def transform_papers(
    paper: DataFrame, topic: DataFrame, paper_topics: DataFrame, model: str, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Assign the papers a model does not hold by their nearest trained papers."""
    fresh = catalog.papers_missing_in_model(paper, paper_topics, topic, model).filter(
        F.col("embedding").isNotNull()
    )
    known = settle(catalog.papers_by_model(paper, paper_topics, topic, model))
    # a paper votes once, for the first of its topics
    base = ranking.dedup_by_key(known.select("id", "embedding", "orig_id"), ["id"], [F.asc("orig_id")])
    near = _neighbours(fresh, settings, settings.min_samples, base)
    rows = clusters.assign_new(near, base.select("id", F.col("orig_id").alias("topic_id")), settings.eps)
    return mutations.import_assignments(topic, paper_topics, model, rows)


def distribute_papers(
    paper: DataFrame, topic: DataFrame, paper_topics: DataFrame, weights: DataFrame, model: str, level: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Assign the outliers of a level to the topics their words resemble."""
    docs = catalog.outlier_papers(paper, paper_topics, topic, level).select(
        F.col("id").alias("doc_id"), F.col("abstract").alias("text")
    )
    mix = topic_ops.min_similarity(topic_ops.approximate_distribution(docs, weights))
    rows = mix.select(F.col("doc_id").alias("paper_id"), "topic_id", "probability")
    return mutations.import_assignments(topic, paper_topics, model, rows, distributed=True)


def agglomerate(
    paper: DataFrame, topic: DataFrame, paper_topics: DataFrame, counts: DataFrame, model: str,
    parent_model: str, level: int, max_distance: float, n_words: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Merge the similar topics of a model into a parent model and put the model below it."""
    weights = settle(topic_ops.c_tf_idf(counts))
    tree = hierarchy.topic_hierarchy(weights.select("topic_id"), topic_ops.topic_similarity(weights))
    groups = topic_ops.maximal_merges(tree, max_distance).select(F.col("parent_id").alias("group_id"), "topics")
    links = catalog.papers_by_model(paper, paper_topics, topic, model)
    docs = links.select(F.col("id").alias("paper_id"), F.col("orig_id").cast("bigint").alias("topic_id"))
    mapping = settle(topic_ops.merge_map(topic_ops.topic_sizes(docs), groups))
    merged = topic_ops.c_tf_idf(topic_ops.merge_counts(counts, mapping))
    lists = topic_ops.word_lists(topic_ops.top_words(merged, n_words), n_words)
    from trendloom.functions.text import topic_name

    name = topic_name(F.col("topic_id"), F.col("words"))
    topics = lists.select("topic_id", name.alias("name"), name.alias("llm_label"))
    rows = topic_ops.merge_topics(docs, mapping).withColumn("probability", F.lit(1.0))
    topic, paper_topics = mutations.import_topics(
        topic, paper_topics, level, parent_model, topics, rows, without_outliers=True
    )
    topic, paper_topics = settle(topic), settle(paper_topics)
    return mutations.update_hierarchy(topic, paper_topics, model, parent_model)
