"""A merge tree over topics (Ward linkage on one minus cosine)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators import topics as topic_ops
from trendloom.operators.ranking import with_position
from trendloom.schemas import OUTLIER
from trendloom.session import settle


def _all_pairs(topics: DataFrame, similarity: DataFrame) -> DataFrame:
    """The distance matrix the linkage needs: (a, b, e), a < b, e the squared distance.

    Its size is the square of the number of topics, not of the documents.
    """
    placed = with_position(topics.select("topic_id").distinct(), [F.asc("topic_id")])
    earlier = placed.filter("position > 0").select(
        F.col("topic_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("position") - 1)).alias("position")
    )
    pairs = earlier.join(placed.withColumnRenamed("topic_id", "a"), "position").select("a", "b")
    known = similarity.select(F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), "similarity")
    distance = 1 - F.coalesce("similarity", F.lit(0.0))
    return pairs.join(known, ["a", "b"], "left").select("a", "b", (distance**2).alias("e"))


def topic_hierarchy(topics: DataFrame, similarity: DataFrame) -> DataFrame:
    """(parent_id, topics, left_id, right_id, distance), one row per merge.

    All mutual nearest neighbours merge in one round, which gives the tree of merging the closest
    pair again and again. Ward's distance of two clusters follows from sums of squared distances
    between and within them; the sums of a merged cluster are sums of its parts, so a round is a
    renaming and a grouping. Parents are numbered after the topics, by distance.
    """
    topics = settle(topics.filter(F.col("topic_id") != OUTLIER).select(F.col("topic_id").cast("bigint").alias("topic_id")).distinct())
    pairs = settle(_all_pairs(topics, similarity))
    nodes = topics.select(
        F.col("topic_id").alias("node"), F.lit(1).alias("n"), F.lit(0.0).alias("w"), F.array("topic_id").alias("topics")
    )
    summary = topics.agg(F.count("*").alias("n"), F.max("topic_id").alias("top")).first()
    left, fresh = summary["n"], (summary["top"] or 0) + 1
    merges = []
    while left > 1:
        size = nodes.select("node", "n", "w")
        ends = pairs.join(size.toDF("a", "na", "wa"), "a").join(size.toDF("b", "nb", "wb"), "b")
        inner = F.col("wa") / F.col("na") ** 2 + F.col("wb") / F.col("nb") ** 2
        square = (2 * F.col("e") - 2 * F.col("na") * F.col("nb") * inner) / (F.col("na") + F.col("nb"))
        # one order for all pairs, so that at least the closest pair is mutual
        close = ends.withColumn("d", F.round(square, 12)).select(F.struct("d", "a", "b", "e").alias("pair"))
        each = close.select(F.explode(F.array("pair.a", "pair.b")).alias("node"), "pair")
        nearest = each.groupBy("node").agg(F.min("pair").alias("pair"))
        mutual = nearest.groupBy("pair").agg(F.count("*").alias("votes")).filter("votes = 2").select("pair.*")
        # one row per merge of the round, fewer than topics
        number = (F.row_number().over(Window.orderBy("d", "a", "b")) - 1 + fresh).cast("bigint")
        joined = settle(mutual.withColumn("parent", number))
        count = joined.count()
        parts = joined.select("parent", "d", "e", F.explode(F.array("a", "b")).alias("node")).join(nodes, "node")
        made = parts.groupBy(F.col("parent").alias("node")).agg(
            F.sum("n").cast("int").alias("n"),
            (F.sum("w") + F.first("e")).alias("w"),
            F.array_sort(F.flatten(F.collect_list("topics"))).alias("topics"),
        )
        merges.append(
            joined.join(made.select(F.col("node").alias("parent"), "topics"), "parent").select(
                "parent", "topics", F.col("a").alias("left_id"), F.col("b").alias("right_id"), "d"
            )
        )
        renamed = joined.select("parent", F.explode(F.array("a", "b")).alias("node"))
        nodes = settle(nodes.join(renamed, "node", "left_anti").unionByName(made))
        new_a, new_b = F.coalesce("_pa", "a"), F.coalesce("_pb", "b")
        moved = pairs.join(renamed.select(F.col("node").alias("a"), F.col("parent").alias("_pa")), "a", "left").join(
            renamed.select(F.col("node").alias("b"), F.col("parent").alias("_pb")), "b", "left"
        )
        pairs = settle(
            moved.select(F.least(new_a, new_b).alias("a"), F.greatest(new_a, new_b).alias("b"), "e")
            .filter("a <> b")
            .groupBy("a", "b")
            .agg(F.sum("e").alias("e"))
        )
        left, fresh = left - count, fresh + count
    if not merges:
        return topics.sparkSession.createDataFrame(
            [], "parent_id bigint, topics array<bigint>, left_id bigint, right_id bigint, distance double"
        )
    return _numbered(settle(reduce(DataFrame.unionByName, merges)), (summary["top"] or 0) + 1)


def _numbered(merges: DataFrame, first: int) -> DataFrame:
    """Number the parents by distance, as if the merges had come one at a time."""
    # one row per merge, fewer than topics
    order = Window.orderBy("d", "parent")
    ranked = merges.withColumn("parent_id", (F.row_number().over(order) - 1 + first).cast("bigint"))
    names = ranked.select("parent", "parent_id")
    for side in ("left_id", "right_id"):
        known = names.select(F.col("parent").alias(side), F.col("parent_id").alias("_new"))
        ranked = ranked.join(known, side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
    return ranked.select(
        "parent_id", "topics", "left_id", "right_id", F.sqrt(F.greatest("d", F.lit(0.0))).alias("distance")
    )


def evaluate_model(
    docs: DataFrame, weights: DataFrame, heatmap: bool = True, barchart: bool = False, hierarchy: bool = False
) -> dict[str, DataFrame]:
    """The data behind the heat map, the bar chart and the merge tree of a model."""
    result = {}
    if heatmap or hierarchy:
        similarity = settle(topic_ops.topic_similarity(weights))
    if heatmap:
        result["similarity"] = similarity
    if barchart:
        result["barchart"] = topic_ops.topic_barchart_data(docs, weights)
    if hierarchy:
        result["hierarchy"] = topic_hierarchy(weights.select("topic_id"), similarity)
    return result
