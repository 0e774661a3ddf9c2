"""Queries that train, apply and merge whole models over documents with embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import selection
from trendloom.operators import topics as topic_ops
from trendloom.plans import subsets, topics, training, vectors, views  # noqa: F401  (their views are used)
from trendloom.plans.registry import query, view
from trendloom.session import settle, work_dir
from trendloom.sources import tables

SETTINGS = training.Settings(neighbours=6, min_samples=2, min_cluster_size=4, eps=0.65)


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have an embedding, as papers."""
    vectors = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    texts = views.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"))
    return settle(texts.join(vectors, "id"))


def _empty(spark: SparkSession, *names: str) -> list[DataFrame]:
    none = work_dir(spark, "none")
    return [tables.read_table(spark, none, name) for name in names]


def _model_views(name: str, points: str) -> None:
    """SQL of a model trained with SETTINGS on some of the embeddings; ``name``_members has (id,
    orig_id, probability)."""
    k, samples, size, eps = SETTINGS.neighbours, SETTINGS.min_samples, SETTINGS.min_cluster_size, SETTINGS.eps
    view(f"{name}_points", points)
    view(f"{name}_knn", f"""
SELECT * FROM (SELECT a.id, neighbour, distance, row_number() OVER (PARTITION BY a.id ORDER BY distance, neighbour) AS rank
  FROM cosine_pairs p JOIN {name}_points a ON a.id = p.id JOIN {name}_points b ON b.id = p.neighbour) WHERE rank <= {k}""",
        f"{name}_points", "cosine_pairs")
    view(f"{name}_core", f"SELECT id, max(distance) AS core FROM {name}_knn WHERE rank <= {samples} GROUP BY id", f"{name}_knn")
    view(f"{name}_edges", f"""
SELECT k.id AS a, neighbour AS b FROM {name}_knn k JOIN {name}_core c ON c.id = k.id JOIN {name}_core d ON d.id = k.neighbour
WHERE greatest(distance, c.core, d.core) <= {eps}""", f"{name}_knn", f"{name}_core")
    view(f"{name}_reached", f"""
SELECT id AS root, id FROM {name}_core
UNION
SELECT r.root, CASE WHEN e.a = r.id THEN e.b ELSE e.a END FROM {name}_reached r JOIN {name}_edges e ON e.a = r.id OR e.b = r.id""",
        f"{name}_core", f"{name}_edges")
    view(f"{name}_labels", f"SELECT id, min(root) AS root FROM {name}_reached GROUP BY id", f"{name}_reached")
    view(f"{name}_ranks", f"""
SELECT root, CASE WHEN n >= {size} THEN row_number() OVER (ORDER BY n DESC, root) - 1 ELSE -1 END AS orig_id
FROM (SELECT root, count(*) AS n FROM {name}_labels GROUP BY root)""", f"{name}_labels")
    view(f"{name}_members", f"""
SELECT id, orig_id, round(CASE WHEN orig_id = -1 THEN 0 ELSE min(core) OVER (PARTITION BY orig_id) / core END, 9) AS probability
FROM {name}_labels JOIN {name}_ranks USING (root) JOIN {name}_core USING (id)""", f"{name}_labels", f"{name}_ranks", f"{name}_core")


_model_views("trained", "SELECT vec_id AS id FROM embeddings JOIN documents ON doc_id = vec_id")
_model_views("part", "SELECT vec_id AS id FROM embeddings JOIN documents ON doc_id = vec_id WHERE label < 7")


@query("""SELECT 'm' AS model, 0 AS hierarchy, CAST(orig_id AS INT) AS orig_id, CAST(count(*) OVER (PARTITION BY orig_id) AS BIGINT) AS paper_count,
                 CAST(id AS BIGINT) AS paper_id, probability, 0 AS transformed FROM trained_members""", "trained_members", recursive=True)
def train_model(spark, sf):
    """A model trained on all documents with an embedding: its topics with their papers."""
    store = _empty(spark, "topic", "paper_topics", "topic_stats")
    topic, links, _ = training.train_model(*store, _papers(spark, sf), "m", 0, SETTINGS)
    joined = settle(links).join(topic.select(F.col("id").alias("topic_id"), "model", "hierarchy", "orig_id", "paper_count"), "topic_id")
    return joined.select(
        "model", "hierarchy", "orig_id", "paper_count", "paper_id", F.round("probability", 9).alias("probability"), "transformed"
    )


SWEEP = training.Settings(neighbours=6, eps=0.65, sweep_samples=(2, 3), sweep_sizes=(3, 4, 8), min_clusters=3, strict=False)


@query()
def swept_model(spark, sf):
    """Topics, with names, of a model whose settings a sweep picks, trained on 70 % of each class."""
    papers = _papers(spark, sf)
    labels = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").cast("bigint").alias("topic_id"), F.lit(1.0).alias("probability"))
    classes = labels.groupBy("topic_id").agg(F.count("*").alias("paper_count")).select(
        F.col("topic_id").alias("id"), F.lit(0).alias("hierarchy"), F.col("topic_id").cast("int").alias("orig_id"), "paper_count"
    )
    selected = selection.sample_by_topic(labels, classes, 0, 70)
    store = _empty(spark, "topic", "paper_topics", "topic_stats")
    topic, _, _ = training.train_model(*store, papers, "m", 0, SWEEP, selected=selected)
    return topic.select("id", "hierarchy", "model", "orig_id", "name", "llm_label", "paper_count")


# members of archives and large categories, their neighbours within the subset, and clusters of these
SUBSETS = training.Settings(neighbours=6, min_samples=2, min_cluster_size=3, eps=0.7)

view("subset_members", """
WITH totals AS (SELECT archive, sum(paper_count) AS papers FROM category GROUP BY archive)
SELECT DISTINCT CASE WHEN papers > 1000 AND paper_count > 500 THEN name ELSE archive END AS subset, paper_id AS id
FROM category JOIN totals USING (archive) JOIN paper_categories ON category_id = category.id
JOIN paper_vectors p ON p.id = paper_id AND embedding IS NOT NULL""", "category", "paper_categories", "paper_vectors")

view("subset_knn", """
SELECT * FROM (
  SELECT a.subset, a.id, p.neighbour, p.distance, row_number() OVER (PARTITION BY a.subset, a.id ORDER BY p.distance, p.neighbour) AS rank
  FROM subset_members a JOIN cosine_pairs p ON p.id = a.id JOIN subset_members b ON b.subset = a.subset AND b.id = p.neighbour)
WHERE rank <= 6""", "subset_members", "cosine_pairs")

view("subset_core", "SELECT subset, id, max(distance) AS core FROM subset_knn WHERE rank <= 2 GROUP BY ALL", "subset_knn")

view("subset_edges", """
SELECT k.subset, k.id AS a, neighbour AS b FROM subset_knn k
JOIN subset_core c ON c.subset = k.subset AND c.id = k.id JOIN subset_core d ON d.subset = k.subset AND d.id = k.neighbour
WHERE greatest(distance, c.core, d.core) <= 0.7""", "subset_knn", "subset_core")

view("subset_reached", """
SELECT subset, id AS root, id FROM subset_core
UNION
SELECT r.subset, r.root, CASE WHEN e.a = r.id THEN e.b ELSE e.a END
FROM subset_reached r JOIN subset_edges e ON e.subset = r.subset AND (e.a = r.id OR e.b = r.id)""", "subset_core", "subset_edges")

view("subset_topics", """
SELECT subset, root, n, CASE WHEN n >= 3 THEN row_number() OVER (PARTITION BY subset ORDER BY n DESC, root) - 1 ELSE -1 END AS orig_id
FROM (SELECT subset, root, count(*) AS n FROM (SELECT subset, id, min(root) AS root FROM subset_reached GROUP BY ALL) GROUP BY ALL)""", "subset_reached")


@query("""SELECT 'subset_' || subset AS model, -1 AS hierarchy, CAST(orig_id AS INT) AS orig_id, CAST(sum(n) AS BIGINT) AS paper_count,
                 CASE WHEN orig_id = -1 THEN coalesce(name, subset) END AS outliers
          FROM subset_topics LEFT JOIN (SELECT DISTINCT archive AS code, 'all of ' || archive AS name FROM category) ON code = subset
          GROUP BY ALL""", "subset_topics category", recursive=True)
def train_subset_models(spark, sf):
    """Topics of the models of all subsets; archives have names, categories of their own none."""
    papers = views.paper_vectors(spark, sf).withColumn("abstract", F.col("title"))
    category = settle(views.category(spark, sf))
    names = category.select(F.col("archive").alias("code"), F.concat(F.lit("all of "), "archive").alias("name")).distinct()
    store = _empty(spark, "topic", "paper_topics")
    topic, _ = subsets.train_subset_models(
        papers, category, views.paper_categories(spark, sf), *store, 1000, 500, SUBSETS, names
    )
    label = F.when(F.col("orig_id") == -1, F.col("llm_label")).alias("outliers")
    return topic.select("model", "hierarchy", "orig_id", "paper_count", label)


view("part_votes", f"""
SELECT id, CASE WHEN distance <= {SETTINGS.eps} THEN orig_id ELSE -1 END AS orig_id, count(*) AS n FROM (
  SELECT p.id, m.orig_id, distance, row_number() OVER (PARTITION BY p.id ORDER BY distance, m.id) AS rank
  FROM cosine_pairs p JOIN part_members m ON m.id = p.neighbour
  WHERE p.id NOT IN (SELECT id FROM part_members) AND p.id IN (SELECT doc_id FROM documents))
WHERE rank <= {SETTINGS.min_samples} GROUP BY ALL""", "cosine_pairs", "part_members")


@query("""SELECT CAST(id AS BIGINT) AS paper_id, CAST(orig_id + 2 AS BIGINT) AS topic_id, probability, 0 AS transformed FROM part_members
          UNION ALL
          SELECT CAST(id AS BIGINT), CAST(orig_id + 2 AS BIGINT), round(CASE WHEN orig_id = -1 THEN 0 ELSE n / total END, 9), 1 FROM (
            SELECT *, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, orig_id) AS place FROM part_votes)
          WHERE place = 1""", "part_members part_votes", recursive=True)
def transform_papers(spark, sf):
    """Two thirds of the classes train a model that the rest is assigned to."""
    papers = _papers(spark, sf)
    labels = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    labelled = papers.join(labels, "id")
    store = _empty(spark, "topic", "paper_topics", "topic_stats")
    topic, links, _ = training.train_model(*store, labelled.filter("label < 7").drop("label"), "m", 0, SETTINGS)
    topic, links = settle(topic), settle(links)
    _, links = training.transform_papers(papers, topic, links, "m", SETTINGS)
    return links.select("paper_id", "topic_id", F.round("probability", 9).alias("probability"), "transformed")


@query()
def reduce_topics(spark, sf):
    docs = views.docs(spark, sf)
    return training.reduce_topics(docs, settle(topic_ops.term_counts(docs)), 0.6)


@query("""SELECT doc_id AS paper_id, CAST(topic_id + 2 AS BIGINT) AS topic_id, 1.0::DOUBLE AS probability, 0 AS transformed FROM docs
          UNION ALL
          SELECT d.doc_id, CAST(p.topic_id + 2 AS BIGINT), round(probability, 9), 2
          FROM distribution p JOIN docs d ON d.doc_id = p.doc_id WHERE d.topic_id = -1 AND probability > 0.15""", "docs distribution")
def distribute_papers(spark, sf):
    """Outlier documents go to the topics of the others by their words."""
    docs = settle(views.docs(spark, sf))
    weights = settle(topic_ops.c_tf_idf(topic_ops.term_counts(docs)))
    topic = topic_ops.topic_sizes(docs).select(
        (F.col("topic_id") + 2).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(0).alias("hierarchy"), F.lit("m").alias("model"), F.col("topic_id").alias("orig_id"),
        F.lit("").alias("name"), F.lit("").alias("llm_label"), F.lit(0).cast("bigint").alias("paper_count"),
    )
    links = docs.select(
        F.col("doc_id").alias("paper_id"), (F.col("topic_id") + 2).cast("bigint").alias("topic_id"),
        F.lit(1.0).alias("probability"), F.lit(0).alias("transformed"),
    )
    papers = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"))
    _, links = training.distribute_papers(papers, topic, links, weights, "m")
    return links.select("paper_id", "topic_id", F.round("probability", 9).alias("probability"), "transformed")
