"""Queries that make new versions of tables, and round trips through storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import catalog, ingest, mutations
from trendloom.plans import cleaning, monthly, views  # noqa: F401  (their views are used)
from trendloom.plans.registry import query, view
from trendloom.session import settle, work_dir
from trendloom.sources import records, tables


view("shared", """
SELECT c.topic_id AS child_id, p.topic_id AS parent_id, count(*) AS papers,
       row_number() OVER (PARTITION BY c.topic_id ORDER BY count(*) DESC, p.topic_id) AS rn
FROM paper_topics c JOIN topic tc ON tc.id = c.topic_id AND tc.model = 'm0' AND tc.orig_id <> -1
JOIN paper_topics p ON p.paper_id = c.paper_id JOIN topic tp ON tp.id = p.topic_id AND tp.model = 'm1'
GROUP BY c.topic_id, p.topic_id""", "topic")


@query("""SELECT id, min(probability) AS probability FROM (
            SELECT paper_id AS id, CASE WHEN transformed = 0 THEN probability END AS probability FROM m0_links WHERE transformed = 0
            UNION ALL SELECT paper_id, max(probability) FROM m0_links GROUP BY paper_id
              HAVING min(transformed) > 0) GROUP BY id""", "m0_links")
def insert_or_ignore(spark, sf):
    links = views.m0_links(spark, sf).select(F.col("paper_id").alias("id"), "probability", "transformed")
    target = links.filter("transformed = 0").groupBy("id").agg(F.min("probability").alias("probability"))
    return mutations.insert_or_ignore(
        target, links.select("id", "probability"), ["id"], [F.desc("probability")]
    )


@query("""SELECT (SELECT max(id) FROM topic) + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id,
                 o_orderkey AS key FROM orders""", "topic")
def assign_ids(spark, sf):
    rows = views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return mutations.assign_ids(
        views.bare_topic(spark, sf), rows, [F.desc("o_totalprice"), F.asc("key")]
    ).select("id", "key")


@query("""SELECT p.id, round(coalesce(n.embedding, p.embedding)[1]::DOUBLE, 6) AS first
          FROM paper_vectors p LEFT JOIN (SELECT vec_id + 100 AS id, embedding FROM embeddings) n ON n.id = p.id""", "paper_vectors")
def update_embeddings(spark, sf):
    fresh = views.load(spark, sf, "embeddings").select((F.col("vec_id") + 100).alias("id"), "embedding")
    updated = mutations.update_embeddings(views.paper_vectors(spark, sf), fresh)
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return updated.select("id", first.alias("first"))


@query("""SELECT id, model, CASE WHEN model = 'm0' AND orig_id >= 0 THEN 'New ' || orig_id ELSE llm_label END AS llm_label FROM topic""", "topic")
def update_labels(spark, sf):
    topic = views.bare_topic(spark, sf)
    labels = topic.filter("model = 'm0' and orig_id >= 0").select(
        F.col("orig_id").alias("topic_id"), F.concat(F.lit("New "), F.col("orig_id").cast("string")).alias("llm_label")
    )
    return mutations.update_labels(topic, labels, "m0").select("id", "model", "llm_label")


@query("SELECT paper_id, topic_id, probability FROM m0_links WHERE orig_id <> -1", "m0_links")
def excl_outliers(spark, sf):
    links = views.m0_links(spark, sf)
    local = links.select("paper_id", F.col("orig_id").alias("topic_id"), "probability", F.col("topic_id").alias("t"))
    return mutations.excl_outliers(local).select("paper_id", F.col("t").alias("topic_id"), "probability")


def _new_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    topics = views.bare_topic(spark, sf).filter("model = 'm0'").select(
        F.col("orig_id").alias("topic_id"), "name", "llm_label"
    )
    links = views.m0_links(spark, sf).select("paper_id", F.col("orig_id").alias("topic_id"), "probability")
    return topics, links


@query("""SELECT id, hierarchy, model, orig_id, paper_count FROM topic
          UNION ALL
          SELECT (SELECT max(id) FROM topic) + row_number() OVER (ORDER BY orig_id), 2, 'fresh', orig_id,
                 CASE WHEN orig_id = -1 THEN 0 ELSE paper_count END FROM topic WHERE model = 'm0'""", "topic")
def import_topics(spark, sf):
    topics, links = _new_model(spark, sf)
    topic, _ = mutations.import_topics(
        views.bare_topic(spark, sf), settle(views.paper_topics(spark, sf)), 2, "fresh", topics, links, without_outliers=True
    )
    return topic.select("id", "hierarchy", "model", "orig_id", "paper_count")


@query("""SELECT id, paper_id, topic_id, probability, transformed FROM (
            SELECT paper_id * 10000 + topic_id AS id, paper_id, topic_id, probability, transformed FROM paper_topics
            UNION ALL SELECT p.paper_id * 10000 + t.id, p.paper_id, t.id, p.probability, 1
            FROM (SELECT paper_id, orig_id, probability FROM m0_links) p JOIN topic t ON t.model = 'm1' AND t.orig_id = p.orig_id
            WHERE NOT EXISTS (SELECT 1 FROM paper_topics x WHERE x.paper_id = p.paper_id AND x.topic_id = t.id))""",
       "m0_links paper_topics topic")
def import_assignments(spark, sf):
    local = views.m0_links(spark, sf).select("paper_id", F.col("orig_id").alias("topic_id"), "probability")
    _, links = mutations.import_assignments(
        views.bare_topic(spark, sf), settle(views.paper_topics(spark, sf)), "m1", local
    )
    return links.select((F.col("paper_id") * 10000 + F.col("topic_id")).alias("id"), "*")


@query("""SELECT t.id, CASE WHEN t.model = 'm0' AND t.orig_id <> -1 THEN p.parent_id END AS parent_id,
                 CASE WHEN t.model = 'm1' THEN c.n ELSE t.paper_count END AS paper_count
          FROM topic t
          LEFT JOIN (SELECT child_id, parent_id FROM shared WHERE rn = 1) p ON p.child_id = t.id
          LEFT JOIN (SELECT topic_id, count(DISTINCT paper_id) AS n FROM (
                       SELECT topic_id, paper_id FROM paper_topics UNION ALL
                       SELECT s.parent_id, x.paper_id FROM paper_topics x JOIN shared s ON s.child_id = x.topic_id AND s.rn = 1)
                     GROUP BY 1) c ON c.topic_id = t.id""", "topic shared")
def update_hierarchy(spark, sf):
    # a stored table in use: read for the topics, their parents and the copies
    links = settle(views.paper_topics(spark, sf))
    topics = settle(catalog.topic_paper_count(views.bare_topic(spark, sf), links))
    topic, _ = mutations.update_hierarchy(topics, links, "m0", "m1")
    return topic.select("id", "parent_id", "paper_count")


@query("""SELECT 'topic' AS kind, t.id, CASE WHEN t.model = 'm0' AND t.orig_id >= 0 THEN NULL ELSE t.parent_id END AS parent_id, t.paper_count AS n
          FROM topic t WHERE model <> 'm1'
          UNION ALL SELECT 'links', topic_id, NULL, count(*) FROM paper_topics WHERE topic_id NOT IN (SELECT id FROM topic WHERE model = 'm1') GROUP BY 2
          UNION ALL SELECT 'stats', topic_id, NULL, count(*) FROM topic_stats WHERE topic_id NOT IN (SELECT id FROM topic WHERE model = 'm1') GROUP BY 2""",
       "topic topic_stats")
def delete_model(spark, sf):
    links = views.paper_topics(spark, sf)
    topic = views.topic(spark, sf).withColumn(
        "parent_id",
        F.when((F.col("model") == "m0") & (F.col("orig_id") >= 0), F.floor(F.col("orig_id") / 5) + 100),
    )
    from trendloom.operators.stats import topic_stats

    topic, links, stats = mutations.delete_model(topic, links, topic_stats(views.paper(spark, sf), links), "m1")
    nothing = F.lit(None).cast("bigint").alias("parent_id")
    parts = [topic.select(F.lit("topic").alias("kind"), "id", "parent_id", F.col("paper_count").alias("n"))]
    for kind, frame in (("links", links), ("stats", stats)):
        counts = frame.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("n"))
        parts.append(counts.select(F.lit(kind).alias("kind"), "id", nothing, "n"))
    return catalog.concat_frames(parts)


@query("""SELECT 'paper' AS kind, CAST(id AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS id, title AS name FROM stages WHERE stage = 'imported'
          UNION ALL
          SELECT 'category', count(*), row_number() OVER (ORDER BY name), name FROM (
            SELECT DISTINCT id, unnest(list_slice(str_split(categories, ' '), 1, 3)) AS name FROM stages WHERE stage = 'imported') GROUP BY name""", "stages")
def import_papers(spark, sf):
    papers = ingest.imported_papers(ingest.clean_snapshot(views.snapshot(spark, sf), 2000, cleaning.MARK))
    empty = [tables.read_table(spark, work_dir(spark, "none"), t) for t in ("paper", "category", "paper_categories")]
    paper, category, _ = mutations.import_papers(*empty, papers)
    return paper.select(
        F.lit("paper").alias("kind"), F.col("source_id").cast("bigint").alias("n"), "id", F.col("title").alias("name")
    ).unionByName(category.select(F.lit("category").alias("kind"), F.col("paper_count").alias("n"), "id", "name"))


@query("SELECT id, title, categories, update_date FROM snapshot", "snapshot")
def read_snapshot(spark, sf):
    path = work_dir(spark, "snapshot")
    views.snapshot(spark, sf).write.json(path)
    return records.read_snapshot(spark, path).select(
        "id", "title", "categories", F.col("update_date").cast("date").alias("update_date")
    )


@query("SELECT DISTINCT p_type AS code, lower(p_type) AS name FROM part UNION SELECT DISTINCT p_brand, lower(p_brand) FROM part")
def read_taxonomy(spark, sf):
    """Types in one file and, with other names, again beside the brands in a second one."""
    parts = views.load(spark, sf, "part")
    types = parts.select(F.col("p_type").alias("code"), F.lower("p_type").alias("name")).distinct()
    brands = parts.select(F.col("p_brand").alias("code"), F.lower("p_brand").alias("name")).distinct()
    again = brands.unionByName(types.withColumn("name", F.lit("again")))
    paths = []
    for number, codes in enumerate((types, again)):
        entry = F.struct("code", F.struct(F.col("name").alias("name")).alias("entry"))
        one = codes.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
        paths.append(work_dir(spark, f"taxonomy{number}"))
        one.write.text(paths[-1])
    return records.read_taxonomy(spark, paths)


@query("""SELECT topic_id, count(*) AS papers, CAST(sum(transformed) AS BIGINT) AS t FROM paper_topics
          WHERE topic_id < 100 OR transformed = 0 GROUP BY 1""", "paper_topics")
def write_and_read_table(spark, sf):
    """Append, then replace a table by a filtered version of itself."""
    root = work_dir(spark, "tables")
    links = views.paper_topics(spark, sf)
    tables.write_table(links.filter("topic_id < 100"), root, "paper_topics", "append")
    tables.write_table(links.filter("topic_id >= 100"), root, "paper_topics", "append")
    current = tables.read_table(spark, root, "paper_topics")
    tables.write_table(current.filter("topic_id < 100 or transformed = 0"), root, "paper_topics")
    return (
        tables.read_table(spark, root, "paper_topics")
        .groupBy("topic_id")
        .agg(F.count("*").alias("papers"), F.sum("transformed").alias("t"))
    )


@query("SELECT category_id, year, month, paper_count FROM category_stats", "category_stats")
def replace_stats(spark, sf):
    from trendloom.operators.stats import category_stats

    root = work_dir(spark, "stats")
    links = views.paper_categories(spark, sf)
    for part in (links.filter("is_primary = 1"), links):
        tables.write_table(category_stats(views.paper(spark, sf), part), root, "category_stats")
    return tables.read_table(spark, root, "category_stats").select("category_id", "year", "month", "paper_count")
