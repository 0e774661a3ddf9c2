"""Models of all subsets of the categories, trained together.

A paper is a member of every subset that one of its categories belongs to. Members of all subsets
go through neighbours, clusters, ranks and word weights side by side, told apart by their subset, so
the number of jobs does not depend on the number of subsets and no name passes the driver.

A subset of at most ``neighbours.WHOLE`` members is compared pair by pair in a task. Larger ones, of which
there are few, go through the neighbour search together: neighbours stay within a subset because every
vector gets a further coordinate per large subset, in which members of different subsets are orthogonal: the cosine of two members becomes
(cos + C) / (1 + C) within a subset and cos / (1 + C) across. With C = 3 the farthest member
of the own subset is nearer than the nearest of another, and cells of other subsets are ruled out
like other far cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.functions.text import topic_name
from trendloom.operators import catalog, clusters, mutations, neighbours
from trendloom.operators import topics as topic_ops
from trendloom.operators.ranking import rank_in_groups, with_position
from trendloom.plans.training import Settings
from trendloom.schemas import OUTLIER
from trendloom.session import settle

APART = 3.0
MODEL = "subset_"
MARK = "\x1f"  # between a subset's number and a term


def subset_members(
    paper: DataFrame, category: DataFrame, paper_categories: DataFrame, archive_max: int, category_min: int
) -> DataFrame:
    """(subset, id, abstract, embedding): papers with an embedding, once per subset they train in."""
    subsets = catalog.subset_map(category, archive_max, category_min)
    wanted = paper_categories.join(subsets, "category_id").select("subset", F.col("paper_id").alias("id")).distinct()
    usable = paper.filter(F.col("embedding").isNotNull()).select("id", "abstract", "embedding")
    return usable.join(wanted, "id").select("subset", "id", "abstract", "embedding")


def knn_within(members: DataFrame, k: int, **search) -> DataFrame:
    """(id, neighbour, distance, rank) by cosine among the members of each subset.

    ``members`` has unique ``id``, ``place`` (the subset's number from 0) and ``embedding``.
    """
    sizes = members.groupBy("place").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > neighbours.WHOLE).select("place")
    numbered = settle(with_position(large, [F.asc("place")], "_large"))
    small = members.join(numbered, "place", "left_anti")
    near = neighbours.knn_in_groups(small.select("id", "place", "embedding"), "place", k)
    count = numbered.count()
    if not count:
        return near
    unit = scalars.normalize_vector(F.col("embedding"))
    own = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")),
        lambda i: F.when(i == F.col("_large"), F.lit(APART**0.5)).otherwise(F.lit(0.0)),
    )
    wide = members.join(numbered, "place").select("id", unit.alias("_unit"), own.alias("_own")).filter(F.col("_unit").isNotNull())
    found = neighbours.knn_cosine(wide.select("id", F.concat("_unit", "_own").alias("embedding")), k, **search)
    # within a subset the stretched distance is at most 2 / (1 + APART), across it is larger
    within = found.filter(F.col("distance") <= 2 / (1 + APART) + 1e-8)
    return near.unionByName(within.withColumn("distance", F.round(F.col("distance") * (1 + APART), 9)))


def c_tf_idf_within(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """``topics.c_tf_idf`` for each subset: (subset, topic_id, term, weight)."""
    per_term = Window.partitionBy("subset", "term")  # a row per topic of the subset
    totals = counts.withColumns({"_f": F.sum("tf").over(per_term), "_topics": F.count("*").over(per_term)})
    kept = settle(totals.filter(F.col("_topics") >= min_df).drop("_topics"))
    sizes = kept.groupBy("subset", "topic_id").agg(F.sum("tf").alias("_size"))
    mean = sizes.groupBy("subset").agg(F.floor(F.avg("_size")).cast("double").alias("_mean"))
    sized = settle(sizes.join(mean, "subset"))
    idf = F.log1p(F.col("_mean") / F.col("_f"))
    joined = kept.join(sized, ["subset", "topic_id"])
    return joined.select("subset", "topic_id", "term", (F.col("tf") / F.col("_size") * idf).alias("weight"))


def train_subsets(members: DataFrame, settings: Settings, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Topics (model, topic_id, name, llm_label) and assignments (model, paper_id, topic_id,
    probability) of one model per subset of the members (subset, id, abstract, embedding).

    The outlier topic is labelled with the subset's name from ``names`` (code, name), or its code.
    """
    subsets = settle(with_position(members.select("subset").distinct(), [F.asc("subset")], "place"))
    placed = members.join(subsets, "subset")
    rows = settle(with_position(placed, [F.asc("place"), F.asc("id")], "member"))
    near = settle(
        knn_within(
            rows.select(F.col("member").alias("id"), "place", "embedding"), settings.neighbours, probes=settings.probes
        )
    )
    core = settle(clusters.core_distance(near, settings.min_samples))
    # clusters are named by their lowest member, so that no two subsets share one
    found = clusters.density_clusters(near, settings.min_samples, settings.min_cluster_size, settings.eps)
    strong = clusters.membership_strength(found, core).withColumnRenamed("id", "member")
    known = settle(strong.join(rows.select("member", "place", "subset", "id", "abstract"), "member"))
    sizes = known.filter(F.col("cluster") != OUTLIER).groupBy("place", "cluster").agg(F.count("*").alias("size"))
    ranks = settle(rank_in_groups(sizes, ["place"], [F.desc("size"), F.asc("cluster")], "_rank"))
    local = F.coalesce(F.col("_rank") - 1, F.lit(OUTLIER)).cast("bigint")
    docs = settle(
        known.join(ranks.drop("size"), ["place", "cluster"], "left").select(
            "place", "subset", "id", "abstract", "probability", local.alias("topic_id")
        )
    )
    # one number per topic of all subsets, and terms of their own for each subset
    number = F.col("place") * (1 << 32) + F.col("topic_id") + 1
    counts = topic_ops.term_counts(docs.select(number.alias("topic_id"), F.col("abstract").alias("text")))
    weights = c_tf_idf_within(counts.withColumn("subset", F.expr("topic_id div (1L << 32)")), settings.min_df)
    apart = F.concat_ws(MARK, F.col("subset").cast("string"), "term")
    words = topic_ops.mmr_keywords(
        settle(weights.select("topic_id", apart.alias("term"), "weight")), settings.top_words, settings.keyword_diversity
    )
    bare = words.withColumn("term", F.substring_index("term", MARK, -1))
    lists = topic_ops.word_lists(bare, settings.top_words).select(F.col("topic_id").alias("_number"), "words")
    topics = docs.select("subset", "topic_id", number.alias("_number")).distinct()
    listed = topics.join(lists, "_number", "left")
    title = F.col("subset")
    if names is not None:
        listed = listed.join(names.select(F.col("code").alias("subset"), F.col("name").alias("_title")), "subset", "left")
        title = F.coalesce("_title", "subset")
    name = topic_name(F.col("topic_id"), F.coalesce("words", F.array().cast("array<string>")))
    model = F.concat(F.lit(MODEL), "subset").alias("model")
    described = listed.select(
        model, "topic_id", name.alias("name"), F.when(F.col("topic_id") == OUTLIER, title).otherwise(name).alias("llm_label")
    )
    return settle(described), docs.select(model, F.col("id").alias("paper_id"), "topic_id", "probability")


def train_subset_models(
    paper: DataFrame, category: DataFrame, paper_categories: DataFrame, topic: DataFrame, paper_topics: DataFrame,
    archive_max: int, category_min: int, settings: Settings, names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and store one model per subset: new versions of topic and paper_topics.

    Subsets that have a model stay as they are.
    """
    members = subset_members(paper, category, paper_categories, archive_max, category_min)
    held = topic.select("model").distinct()
    fresh = settle(
        members.withColumn("model", F.concat(F.lit(MODEL), "subset")).join(held, "model", "left_anti").drop("model")
    )
    topics, assignments = train_subsets(fresh, settings, names)
    return mutations.import_models(topic, paper_topics, -1, topics, assignments)
