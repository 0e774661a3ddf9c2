"""Density clusters over a neighbour graph, their strength and validity, seeds and new points.

``keys`` names columns that set runs apart (a parameter, a subset): all of them are worked out in
the same jobs. Graph rounds join labels, unique per node, with edges; the edges of a hub that
many points name as neighbour are what adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators.neighbours import core_distance
from trendloom.operators.ranking import first_per_group
from trendloom.schemas import OUTLIER
from trendloom.session import settle


def mutual_reachability(neighbours: DataFrame, core: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, weight), a < b: the larger of the distance and both core distances."""
    pairs = neighbours.select(
        F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "distance"
    ).groupBy("a", "b").agg(F.min("distance").alias("distance"))
    ends = core.select(*keys, F.col("id").alias("a"), F.col("core").alias("_ca"))
    others = core.select(*keys, F.col("id").alias("b"), F.col("core").alias("_cb"))
    return (
        pairs.join(ends, "a")
        .join(others, [*keys, "b"])
        .select(*keys, "a", "b", F.greatest("distance", "_ca", "_cb").alias("weight"))
    )


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, component): each node with the lowest id it is connected to.

    Every round takes the lowest label among the neighbours and then the label of the label, so
    that long chains shrink fast. Rounds end when no label changes.
    """
    keys = list(keys)
    ends = edges.select(*keys, F.inline(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("other")),
    )))
    ends = settle(ends.distinct())
    # points without an edge are done
    labels = ends.select(*keys, "id").distinct().withColumn("component", F.col("id"))
    while True:
        seen = labels.select(*keys, F.col("id").alias("other"), F.col("component").alias("_seen"))
        lowest = ends.join(seen, [*keys, "other"]).groupBy(*keys, "id").agg(F.min("_seen").alias("_low"))
        hooked = settle(
            labels.join(lowest, [*keys, "id"], "left").select(
                *keys, "id", F.least("component", "_low").alias("_next"), "component"
            )
        )
        heads = hooked.select(*keys, F.col("id").alias("_next"), F.col("_next").alias("_head"))
        jumped = settle(
            hooked.join(heads, [*keys, "_next"], "left").select(
                *keys, "id", F.coalesce("_head", "_next").alias("component"), F.col("component").alias("_old")
            )
        )
        changed = not jumped.filter("component <> _old").isEmpty()
        labels = jumped.drop("_old")
        if not changed:
            break
    return nodes.select(*keys, "id").join(labels, [*keys, "id"], "left").select(
        *keys, "id", F.coalesce("component", "id").alias("component")
    )


def _sized(components: DataFrame, min_cluster_size: int | Column, keys: Sequence[str]) -> DataFrame:
    """Components as clusters: those below the size become noise (-1)."""
    group = [*keys, "component"]
    sizes = components.groupBy(*group).agg(F.count("*").alias("_size"))
    cluster = F.when(F.col("_size") >= min_cluster_size, F.col("component")).otherwise(F.lit(OUTLIER))
    return components.join(sizes, group).select(*keys, "id", cluster.cast("bigint").alias("cluster"))


def density_clusters(
    neighbours: DataFrame, min_samples: int, min_cluster_size: int, eps: float
) -> DataFrame:
    """(id, cluster): components of edges within ``eps`` by mutual reachability, small ones noise.

    A cluster is named by its lowest id.
    """
    core = settle(core_distance(neighbours, min_samples))
    edges = mutual_reachability(neighbours, core).filter(F.col("weight") <= eps)
    return _sized(connected_components(core.select("id"), edges), min_cluster_size, [])


def membership_strength(clusters: DataFrame, core: DataFrame) -> DataFrame:
    """(id, cluster, probability): densest core distance of the cluster over the own one; noise 0."""
    placed = clusters.join(core, "id")
    densest = placed.groupBy("cluster").agg(F.min("core").alias("_least"))
    strength = (
        F.when(F.col("cluster") == OUTLIER, 0.0)
        .when(F.col("core") > 0, F.col("_least") / F.col("core"))
        .otherwise(1.0)
    )
    return placed.join(densest, "cluster").select("id", "cluster", strength.alias("probability"))


def spanning_forest(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, weight): the edges of a minimum spanning forest.

    In each round every component takes its lightest outgoing edge; one order over all edges
    (weight, then ends) keeps the choices free of cycles.
    """
    keys = list(keys)
    left = settle(edges.select(*keys, "a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")))
    rounds = []
    while not left.isEmpty():
        edge = F.struct("weight", "a", "b", "ca", "cb")
        offers = left.select(*keys, F.explode(F.array("ca", "cb")).alias("component"), edge.alias("edge"))
        chosen = settle(
            offers.groupBy(*keys, "component").agg(F.min("edge").alias("edge")).select(*keys, "edge.*").distinct()
        )
        rounds.append(chosen.select(*keys, "a", "b", "weight"))
        links = chosen.select(*keys, F.col("ca").alias("a"), F.col("cb").alias("b"))
        nodes = links.select(*keys, F.explode(F.array("a", "b")).alias("id")).distinct()
        merged = connected_components(nodes, links, keys)
        ca = merged.select(*keys, F.col("id").alias("ca"), F.col("component").alias("_ca"))
        cb = merged.select(*keys, F.col("id").alias("cb"), F.col("component").alias("_cb"))
        left = settle(
            left.join(ca, [*keys, "ca"])
            .join(cb, [*keys, "cb"])
            .filter("_ca <> _cb")
            .select(*keys, "a", "b", "weight", F.col("_ca").alias("ca"), F.col("_cb").alias("cb"))
        )
    if not rounds:
        return left.select(*keys, "a", "b", "weight")
    return reduce(DataFrame.unionByName, rounds)


def validity_score(clusters: DataFrame, forest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, clusters, score): density-based validity of a clustering, from -1 to 1.

    Per cluster: the heaviest edge within it against the lightest edge to another cluster, both
    in the spanning forest; weighted by size over all points, noise included.
    """
    keys = list(keys)
    ends = clusters.select(*keys, F.col("id").alias("a"), F.col("cluster").alias("_a"))
    others = clusters.select(*keys, F.col("id").alias("b"), F.col("cluster").alias("_b"))
    edges = settle(forest.join(ends, [*keys, "a"]).join(others, [*keys, "b"]))
    noise = (F.col("_a") == OUTLIER) | (F.col("_b") == OUTLIER)
    both = (F.col("_a") == OUTLIER) & (F.col("_b") == OUTLIER)
    span = edges.groupBy(*keys).agg(
        F.max("weight").alias("_max"), F.min(F.when(noise & ~both, F.col("weight"))).alias("_outlier")
    )
    proper = edges.filter(~noise)
    inner = proper.filter("_a = _b").groupBy(*keys, F.col("_a").alias("cluster")).agg(F.max("weight").alias("_inner"))
    outer = (
        proper.filter("_a <> _b")
        .select(*keys, F.explode(F.array("_a", "_b")).alias("cluster"), "weight")
        .groupBy(*keys, "cluster")
        .agg(F.min("weight").alias("_outer"))
    )
    sizes = clusters.groupBy(*keys, "cluster").agg(F.count("*").alias("_size"))
    totals = sizes.groupBy(*keys).agg(
        F.sum("_size").alias("_total"), F.count_if(F.col("cluster") != OUTLIER).alias("clusters")
    )
    # a constant key stands in where there is one run
    run = keys or ["_run"]
    if not keys:
        sizes, inner, outer, totals, span = (f.withColumn("_run", F.lit(1)) for f in (sizes, inner, outer, totals, span))
    rows = (
        sizes.filter(F.col("cluster") != OUTLIER)
        .join(inner, [*run, "cluster"], "left")
        .join(outer, [*run, "cluster"], "left")
        .join(totals, run)
        .join(span, run, "left")
    )
    # a cluster without an edge to another one lies far away: twice the heaviest edge
    far = 2 * F.when(F.col("clusters") > 1, F.col("_max")).otherwise(F.coalesce("_outlier", "_max"))
    sparse = F.coalesce("_inner", F.lit(0.0))
    apart = F.coalesce("_outer", far)
    worth = F.when(F.greatest(apart, sparse) > 0, (apart - sparse) / F.greatest(apart, sparse)).otherwise(0.0)
    summed = rows.groupBy(*run).agg(F.sum(F.col("_size") * worth / F.col("_total")).alias("_score"))
    # a run without clusters scores 0
    return totals.join(summed, run, "left").select(
        *keys, "clusters", F.coalesce("_score", F.lit(0.0)).alias("score")
    )


def enough_clusters(scores: DataFrame, min_clusters: int) -> int:
    """``min_clusters``, or the most clusters of a setting with a score above 0 if that is less."""
    most = scores.filter(F.col("score") > 0).agg(F.max("clusters")).first()[0]
    return min_clusters if most is None else min(min_clusters, most)


def best_setting(scores: DataFrame, min_clusters: int) -> tuple[int, int] | None:
    """(min_samples, min_cluster_size) of the best row of a sweep's scores, None if none will do."""
    fit = scores.filter((F.col("score") > 0) & (F.col("clusters") >= min_clusters))
    best = fit.orderBy(F.desc(F.round("score", 12)), "min_samples", "min_cluster_size").first()
    return None if best is None else (best["min_samples"], best["min_cluster_size"])


def cluster_sweep(
    neighbours: DataFrame, min_samples: Sequence[int], min_cluster_sizes: Sequence[int],
    min_clusters: int, eps: float, strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(scores, clusters): every pair of settings scored, and the clusters of the best pair.

    The graph, its components and its forest are worked out once for all ``min_samples``; sizes
    only decide which components count. Both lists are in ascending order. The best pair has the highest score above 0 with enough
    clusters, the earliest on a tie (``min_samples`` varies slowest). If no pair has enough clusters,
    that is an error, or, unless ``strict``, the most that a pair with such a score has are enough.
    """
    cores = [core_distance(neighbours, s).withColumn("run", F.lit(i)) for i, s in enumerate(min_samples)]
    core = settle(reduce(DataFrame.unionByName, cores))
    edges = settle(mutual_reachability(neighbours, core, ["run"]))
    components = settle(
        connected_components(core.select("run", "id"), edges.filter(F.col("weight") <= eps), ["run"])
    )
    forest = settle(spanning_forest(edges, ["run"]))
    sized = [
        _sized(components, size, ["run"]).withColumn("size_no", F.lit(i))
        for i, size in enumerate(min_cluster_sizes)
    ]
    clusters = settle(reduce(DataFrame.unionByName, sized))
    numbers = [forest.withColumn("size_no", F.lit(i)) for i in range(len(min_cluster_sizes))]
    keys = ["run", "size_no"]
    scores = settle(validity_score(clusters, reduce(DataFrame.unionByName, numbers), keys))
    enough = min_clusters if strict else enough_clusters(scores, min_clusters)
    fit = scores.filter((F.col("score") > 0) & (F.col("clusters") >= enough))
    best = fit.orderBy(F.desc(F.round("score", 12)), "run", "size_no").first()
    if best is None:
        raise ValueError("no setting gives enough clusters with a positive score")
    named = scores.select(
        F.get(F.array(*(F.lit(s) for s in min_samples)), F.col("run")).alias("min_samples"),
        F.get(F.array(*(F.lit(s) for s in min_cluster_sizes)), F.col("size_no")).alias("min_cluster_size"),
        "clusters",
        "score",
    )
    chosen = clusters.filter((F.col("run") == best["run"]) & (F.col("size_no") == best["size_no"]))
    return named, chosen.select("id", "cluster")


def seeded_clusters(neighbours: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, topic_id): labels spread from seeds to points without one, by majority of neighbours.

    Seeds (id, topic_id) keep their label; -1 stands for unknown. Lower topics win ties. Labels
    spread until a round labels no further point, so every point that a seed reaches gets one, or
    for as many ``rounds`` as asked for.
    """
    edges = settle(neighbours.select("id", "neighbour"))
    fixed = seeds.filter(F.col("topic_id") != OUTLIER).select("id", F.col("topic_id").alias("label"))
    labels = settle(
        edges.select("id").union(seeds.select("id")).distinct().join(fixed, "id", "left")
        .withColumn("seed", F.col("label").isNotNull())
    )
    done, missing = 0, -1
    while done != rounds and missing:
        before = missing
        missing = labels.filter(F.col("label").isNull()).count()
        if rounds is None and missing == before:
            break
        done += 1
        voices = labels.filter(F.col("label").isNotNull()).select(F.col("id").alias("neighbour"), "label")
        open_ends = edges.join(labels.filter(~F.col("seed")).select("id"), "id", "left_semi")
        votes = open_ends.join(voices, "neighbour").groupBy("id", "label").agg(F.count("*").alias("votes"))
        winner = votes.groupBy("id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("_won"))
        labels = settle(
            labels.join(winner, "id", "left").select(
                "id", F.when(F.col("seed"), F.col("label")).otherwise(F.coalesce("_won", "label")).alias("label"), "seed"
            )
        )
    return labels.select("id", F.coalesce("label", F.lit(OUTLIER)).cast("bigint").alias("topic_id"))


def assign_new(neighbours: DataFrame, trained: DataFrame, eps: float) -> DataFrame:
    """(paper_id, topic_id, probability): new points by vote of their trained neighbours.

    Neighbours farther than ``eps`` vote for no topic; the probability is the share of votes of
    the winner, 0 for -1.
    """
    topics = trained.select(F.col("id").alias("neighbour"), "topic_id")
    vote = F.when(F.col("distance") <= eps, F.col("topic_id")).otherwise(F.lit(OUTLIER)).cast("bigint")
    votes = (
        neighbours.join(topics, "neighbour")
        .groupBy("id", vote.alias("topic_id"))
        .agg(F.count("*").alias("votes"))
    )
    # at most one row per neighbour and point
    best = votes.groupBy("id").agg(
        F.max_by("topic_id", F.struct("votes", -F.col("topic_id"))).alias("topic_id"),
        F.max("votes").alias("_won"),
        F.sum("votes").alias("_all"),
    )
    share = F.when(F.col("topic_id") == OUTLIER, 0.0).otherwise(F.col("_won") / F.col("_all"))
    return best.select(F.col("id").alias("paper_id"), "topic_id", share.alias("probability"))
