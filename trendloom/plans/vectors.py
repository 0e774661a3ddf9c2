"""Queries over embeddings: neighbours, clusters, strengths, seeds, new points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import clusters, neighbours
from trendloom.plans import views
from trendloom.plans.registry import query, view
from trendloom.session import settle

K, SAMPLES, SIZE, EPS = 6, 3, 5, 0.62

view("unit_vectors", """
SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings""")

view("cosine_pairs", """
SELECT a.id, b.id AS neighbour, round(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 9) AS distance
FROM unit_vectors a JOIN unit_vectors b ON a.id <> b.id""", "unit_vectors")

view("knn", f"""
SELECT id, neighbour, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM cosine_pairs) WHERE rank <= {K}""", "cosine_pairs")

view("core", f"SELECT id, max(distance) AS core FROM knn WHERE rank <= {SAMPLES} GROUP BY id", "knn")

view("edges", f"""
SELECT DISTINCT least(k.id, neighbour) AS a, greatest(k.id, neighbour) AS b, greatest(distance, c.core, d.core) AS weight
FROM knn k JOIN core c ON c.id = k.id JOIN core d ON d.id = k.neighbour""", "knn", "core")

view("reached", f"""
SELECT id AS root, id FROM core
UNION
SELECT r.root, CASE WHEN e.a = r.id THEN e.b ELSE e.a END FROM reached r JOIN edges e ON (e.a = r.id OR e.b = r.id) AND e.weight <= {EPS}""", "edges")

view("clusters", f"""
SELECT id, CASE WHEN count(*) OVER (PARTITION BY component) >= {SIZE} THEN component ELSE -1 END AS cluster
FROM (SELECT id, min(root) AS component FROM reached GROUP BY id)""", "reached")


view("codes", """
SELECT vec_id AS id, CAST(sum(CASE WHEN x > 0 AND i <= 32 THEN 1 << (32 - i) ELSE 0 END) AS BIGINT) AS hi,
       CAST(sum(CASE WHEN x > 0 AND i > 32 THEN 1 << (64 - i) ELSE 0 END) AS BIGINT) AS lo
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id""")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    return settle(neighbours.knn_cosine(_points(spark, sf), K))


@query("SELECT id, neighbour, distance, CAST(rank AS INT) AS rank FROM knn", "knn")
def knn_cosine(spark, sf):
    return neighbours.knn_cosine(_points(spark, sf), K)


@query("""SELECT id, neighbour, distance, CAST(rank AS INT) AS rank FROM (
            SELECT id, neighbour, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM (
              SELECT a.id, b.id AS neighbour, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS DOUBLE) AS distance
              FROM codes a JOIN codes b ON a.id <> b.id)) WHERE rank <= 6""", "codes")
def knn_hamming(spark, sf):
    codes = _points(spark, sf).select("id", scalars.quantize_bits(F.col("embedding")).alias("codes"))
    return neighbours.knn_hamming(codes, K)


@query("""SELECT l.vec_id AS id, count(*) AS pairs, CAST(sum(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))) AS BIGINT) AS bits
          FROM embeddings l JOIN codes a ON a.id = l.vec_id JOIN codes b ON b.id = l.vec_id + 1 GROUP BY 1""", "codes")
def hamming(spark, sf):
    """Each code with that of the following id."""
    codes = _points(spark, sf).select("id", scalars.quantize_bits(F.col("embedding")).alias("codes"))
    following = codes.select((F.col("id") - 1).alias("id"), F.col("codes").alias("other"))
    bits = scalars.hamming(F.col("codes"), F.col("other")).cast("bigint")
    return codes.join(following, "id").select("id", F.lit(1).cast("bigint").alias("pairs"), bits.alias("bits"))


@query("SELECT id, core FROM core", "core")
def core_distance(spark, sf):
    return neighbours.core_distance(_knn(spark, sf), SAMPLES)


@query("SELECT a, b, weight FROM edges", "edges")
def mutual_reachability(spark, sf):
    near = _knn(spark, sf)
    return clusters.mutual_reachability(near, neighbours.core_distance(near, SAMPLES))


@query("SELECT id, CAST(cluster AS BIGINT) AS cluster FROM clusters", "clusters", recursive=True)
def density_clusters(spark, sf):
    return clusters.density_clusters(_knn(spark, sf), SAMPLES, SIZE, EPS)


@query("""SELECT c.id, CAST(cluster AS BIGINT) AS cluster, round(CASE WHEN cluster = -1 THEN 0 ELSE min(core) OVER (PARTITION BY cluster) / core END, 9) AS probability
          FROM clusters c JOIN core USING (id)""", "clusters", recursive=True)
def membership_strength(spark, sf):
    near = _knn(spark, sf)
    found = clusters.density_clusters(near, SAMPLES, SIZE, EPS)
    strength = clusters.membership_strength(found, neighbours.core_distance(near, SAMPLES))
    return strength.withColumn("probability", F.round("probability", 9))


# labels of the first half of the known classes are seeds, the others unknown
view("first_round", """
SELECT u.id, coalesce(CASE WHEN u.label < 4 THEN u.label END, w.label) AS label, u.label < 4 AS seed FROM unit_vectors u LEFT JOIN (
  SELECT id, label FROM (SELECT k.id, s.label, row_number() OVER (PARTITION BY k.id ORDER BY count(*) DESC, s.label) AS rn
    FROM knn k JOIN unit_vectors s ON s.id = k.neighbour AND s.label < 4 GROUP BY k.id, s.label) WHERE rn = 1) w USING (id)""", "unit_vectors", "knn")


@query("""SELECT f.id, CAST(CASE WHEN seed THEN f.label ELSE coalesce(w.label, f.label, -1) END AS BIGINT) AS topic_id
          FROM first_round f LEFT JOIN (
            SELECT id, label FROM (SELECT k.id, s.label, row_number() OVER (PARTITION BY k.id ORDER BY count(*) DESC, s.label) AS rn
              FROM knn k JOIN first_round s ON s.id = k.neighbour AND s.label IS NOT NULL GROUP BY k.id, s.label) WHERE rn = 1) w USING (id)""", "first_round")
def seeded_clusters(spark, sf):
    seeds = views.load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") < 4, F.col("label")).otherwise(-1).alias("topic_id")
    )
    return clusters.seeded_clusters(_knn(spark, sf), seeds, rounds=2)


view("votes", """
SELECT id, CASE WHEN distance <= 0.65 THEN label ELSE -1 END AS topic_id, count(*) AS n FROM (
  SELECT a.id, b.label, distance, row_number() OVER (PARTITION BY a.id ORDER BY distance, b.id) AS rank
  FROM cosine_pairs p JOIN unit_vectors a ON a.id = p.id AND a.label >= 7 JOIN unit_vectors b ON b.id = p.neighbour AND b.label < 7)
WHERE rank <= 6 GROUP BY ALL""", "cosine_pairs", "unit_vectors")


@query("""SELECT paper_id, CAST(topic_id AS BIGINT) AS topic_id, round(probability, 9) AS probability FROM (
            SELECT id AS paper_id, topic_id, CASE WHEN topic_id = -1 THEN 0 ELSE n / sum(n) OVER (PARTITION BY id) END AS probability,
                   row_number() OVER (PARTITION BY id ORDER BY n DESC, topic_id) AS rn FROM votes) WHERE rn = 1""", "votes")
def assign_new(spark, sf):
    """Points of the last classes are new, the others were trained."""
    points = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    trained = points.filter("label < 7")
    near = neighbours.knn_cosine(points.filter("label >= 7"), K, trained)
    rows = clusters.assign_new(near, trained.select("id", F.col("label").alias("topic_id")), 0.65)
    return rows.withColumn("probability", F.round("probability", 9))


@query()
def spanning_forest(spark, sf):
    near = _knn(spark, sf)
    core = neighbours.core_distance(near, SAMPLES)
    return clusters.spanning_forest(clusters.mutual_reachability(near, core))


@query()
def validity_score(spark, sf):
    near = _knn(spark, sf)
    core = neighbours.core_distance(near, SAMPLES)
    forest = clusters.spanning_forest(clusters.mutual_reachability(near, core))
    score = clusters.validity_score(clusters.density_clusters(near, SAMPLES, SIZE, EPS), forest)
    return score.withColumn("score", F.round("score", 9))


@query()
def cluster_sweep(spark, sf):
    scores, _ = clusters.cluster_sweep(_knn(spark, sf), [2, 3], [4, 8], 1, 0.6)
    return scores.withColumn("score", F.round("score", 9))
