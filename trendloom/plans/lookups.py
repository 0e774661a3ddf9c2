"""Queries over links between papers, categories and topics, and training selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import catalog, selection
from trendloom.plans import views
from trendloom.plans.registry import query


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    """Records with integer ids and their first three category codes."""
    return views.snapshot(spark, sf).select(
        F.col("id").cast("bigint").alias("id"),
        scalars.expand_categories(F.col("categories")).alias("categories"),
    )


@query("""SELECT id, str_split(categories, ' ')[1] AS cat_0, str_split(categories, ' ')[2] AS cat_1,
                 str_split(categories, ' ')[3] AS cat_2 FROM snapshot""", "snapshot")
def expand_categories(spark, sf):
    codes = scalars.expand_categories(F.col("categories"))
    return views.snapshot(spark, sf).select(
        "id", *(F.get(codes, F.lit(i)).alias(f"cat_{i}") for i in range(3))
    )


@query("SELECT name, regexp_extract(name, '^[^.]*') AS archive FROM category", "category")
def archive_of(spark, sf):
    return views.bare_category(spark, sf).select("name", scalars.archive_of(F.col("name")).alias("archive"))


@query("""SELECT DISTINCT cat AS name, split_part(cat, '.', 1) AS archive
          FROM (SELECT unnest(list_slice(str_split(categories, ' '), 1, 3)) AS cat FROM snapshot)""", "snapshot")
def distinct_categories(spark, sf):
    return catalog.distinct_categories(_coded(spark, sf))



@query("""SELECT * FROM (
          WITH codes AS (
            SELECT CAST(id AS BIGINT) AS paper_id, unnest(list_slice(string_split(categories, ' '), 1, 3)) AS name,
                   generate_subscripts(list_slice(string_split(categories, ' '), 1, 3), 1) AS place FROM snapshot)
          SELECT paper_id, name, CAST(min(place) = 1 AS INT) AS is_primary FROM codes GROUP BY ALL)""", "snapshot")
def link_paper_categories(spark, sf):
    papers = _coded(spark, sf)
    names = catalog.distinct_categories(papers).select("name", F.xxhash64("name").alias("id"))
    links = catalog.link_paper_categories(papers, names)
    return links.join(names.withColumnRenamed("id", "category_id"), "category_id").select(
        "paper_id", "name", "is_primary"
    )


@query("""SELECT CAST(s.id AS BIGINT) AS paper_id, str_split(categories, ' ')[1] AS name FROM snapshot s""", "snapshot")
def is_primary(spark, sf):
    papers = _coded(spark, sf)
    names = catalog.distinct_categories(papers).select("name", F.xxhash64("name").alias("id"))
    links = catalog.link_paper_categories(papers, names).filter("is_primary = 1")
    return links.join(names.withColumnRenamed("id", "category_id"), "category_id").select("paper_id", "name")


@query("SELECT id, archive, name, paper_count FROM category", "category")
def category_paper_count(spark, sf):
    return views.category(spark, sf)


@query("SELECT archive, CAST(sum(paper_count) AS BIGINT) AS paper_count FROM category GROUP BY archive", "category")
def archives(spark, sf):
    return catalog.archives(views.category(spark, sf))


@query("SELECT id, model, paper_count FROM topic", "topic")
def topic_paper_count(spark, sf):
    return views.topic(spark, sf).select("id", "model", "paper_count")


# the thresholds split the categories at every scale factor
@query("""SELECT * FROM (
          WITH sized AS (
            SELECT id, name, archive, paper_count, sum(paper_count) OVER (PARTITION BY archive) AS papers FROM category)
          SELECT id AS category_id, name AS subset FROM sized WHERE papers > 1500 AND paper_count > 400 AND name <> archive
          UNION ALL
          SELECT id, archive FROM sized WHERE NOT (papers > 1500 AND paper_count > 400 AND name <> archive))""", "category")
def subset_map(spark, sf):
    return catalog.subset_map(views.category(spark, sf), 1500, 400)


@query("""SELECT DISTINCT p.id FROM paper_vectors p JOIN paper_categories pc ON pc.paper_id = p.id
          JOIN category c ON c.id = pc.category_id
          WHERE c.archive = 'SMALL' AND p.embedding IS NOT NULL""", "paper_vectors category")
def papers_by_categories(spark, sf):
    wanted = views.bare_category(spark, sf).filter("archive = 'SMALL'").select(F.col("id").alias("category_id"))
    return catalog.papers_by_categories(
        views.paper_vectors(spark, sf), views.paper_categories(spark, sf), wanted
    ).select("id")


@query("SELECT id FROM paper_vectors WHERE embedding IS NULL", "paper_vectors")
def papers_without_embedding(spark, sf):
    return catalog.papers_without_embedding(views.paper_vectors(spark, sf)).select("id")


@query("SELECT id, abstract_length FROM paper_vectors WHERE embedding IS NOT NULL", "paper_vectors")
def all_trainable(spark, sf):
    return catalog.all_trainable(views.paper_vectors(spark, sf)).select("id", "abstract_length")


@query("SELECT id, title FROM paper WHERE title NOT ILIKE '%(formula)%'", "paper")
def title_without_formula(spark, sf):
    return catalog.title_without_formula(views.paper(spark, sf)).select("id", "title")


@query("""SELECT * FROM (
          WITH real_topics AS (SELECT id FROM topic WHERE hierarchy = 0 AND orig_id >= 0)
          SELECT id FROM paper
          EXCEPT
          SELECT paper_id FROM paper_topics WHERE topic_id IN (FROM real_topics))""", "paper topic")
def outlier_papers(spark, sf):
    return catalog.outlier_papers(
        views.paper(spark, sf), views.paper_topics(spark, sf), views.bare_topic(spark, sf), 0
    ).select("id")


@query("""SELECT id FROM paper WHERE id NOT IN
            (SELECT paper_id FROM paper_topics pt JOIN topic t ON t.id = pt.topic_id WHERE t.model = 'm1')""",
       "paper topic")
def papers_missing_in_model(spark, sf):
    return catalog.papers_missing_in_model(
        views.paper(spark, sf), views.paper_topics(spark, sf), views.bare_topic(spark, sf), "m1"
    ).select("id")


@query("""SELECT p.id, t.orig_id FROM paper_topics pt JOIN topic t ON t.id = pt.topic_id JOIN paper p ON p.id = pt.paper_id
          WHERE pt.transformed = 0 AND t.model = 'm0'""", "paper topic")
def papers_by_model(spark, sf):
    return catalog.papers_by_model(
        views.paper(spark, sf), views.paper_topics(spark, sf), views.bare_topic(spark, sf), "m0"
    ).select("id", "orig_id")


@query("""SELECT * FROM (
          WITH bare AS (SELECT id AS topic, model, orig_id FROM topic WHERE length(llm_label) = 0),
               links AS (SELECT paper_id, topic_id FROM paper_topics WHERE topic_id IN (SELECT topic FROM bare))
          SELECT model, orig_id AS topic_id, paper.id, title
          FROM paper, links, bare WHERE paper.id = links.paper_id AND links.topic_id = bare.topic)""", "paper topic")
def papers_of_unlabelled_topics(spark, sf):
    return catalog.papers_of_unlabelled_topics(
        views.paper(spark, sf), views.paper_topics(spark, sf), views.bare_topic(spark, sf)
    ).select("model", "topic_id", "id", "title")


@query("""SELECT m.paper_id, t.id AS topic_id, m.probability FROM m0_links m
          JOIN topic t ON t.model = 'm1' AND t.orig_id = m.orig_id""", "m0_links topic")
def resolve_topics(spark, sf):
    local = views.m0_links(spark, sf).select("paper_id", F.col("orig_id").alias("topic_id"), "probability")
    return catalog.resolve_topics(local, views.bare_topic(spark, sf), "m1")


@query("""SELECT DISTINCT model, EXISTS (SELECT 1 FROM topic x WHERE x.model = t.model) AS found
          FROM topic t WHERE hierarchy >= 0""", "topic")
def model_exists(spark, sf):
    topic = views.bare_topic(spark, sf)
    found = {m: catalog.model_exists(topic, m) for m in ("m0", "m1")}
    flag = F.when(F.col("model") == "m0", found["m0"]).otherwise(found["m1"])
    return topic.filter("hierarchy >= 0").select("model").distinct().withColumn("found", flag)


@query("""SELECT * FROM (
          WITH placed AS (SELECT model, hierarchy, sum(paper_count) AS links FROM topic WHERE hierarchy >= 0 GROUP BY ALL),
               papers AS (SELECT 3 * count(*) AS wanted FROM paper)
          SELECT hierarchy, model FROM placed JOIN papers ON links < wanted)""", "paper topic")
def models_for_transform(spark, sf):
    # each paper thrice, so that one of the two models falls short at every scale
    papers = views.paper(spark, sf)
    return catalog.models_for_transform(views.topic(spark, sf), papers.union(papers).union(papers))


@query("""SELECT paper_id, count(*) AS topics FROM paper_topics pt JOIN topic t ON t.id = pt.topic_id
          WHERE t.hierarchy = 0 AND t.orig_id <> -1 GROUP BY paper_id HAVING count(*) > 1""", "topic")
def multi_topic_papers(spark, sf):
    return catalog.multi_topic_papers(views.paper_topics(spark, sf), views.bare_topic(spark, sf), 0)


@query("""SELECT child_id, parent_id, papers FROM (
            SELECT c.topic_id AS child_id, p.topic_id AS parent_id, count(*) AS papers,
                   row_number() OVER (PARTITION BY c.topic_id ORDER BY count(*) DESC, p.topic_id) AS rn
            FROM paper_topics c JOIN topic tc ON tc.id = c.topic_id AND tc.model = 'm0' AND tc.orig_id <> -1
            JOIN paper_topics p ON p.paper_id = c.paper_id JOIN topic tp ON tp.id = p.topic_id AND tp.model = 'm1'
            GROUP BY c.topic_id, p.topic_id) WHERE rn = 1""", "topic")
def parent_topic(spark, sf):
    return catalog.parent_topic(views.paper_topics(spark, sf), views.bare_topic(spark, sf), "m0", "m1")


@query("""SELECT id, model, CASE WHEN orig_id = -1 THEN coalesce(
                   (SELECT min(lower(p_type)) FROM part WHERE 'subset_' || p_type = model), 'Outliers')
                 ELSE llm_label END AS llm_label
          FROM topic""", "topic")
def outlier_label(spark, sf):
    taxonomy = views.load(spark, sf, "part").select(
        F.col("p_type").alias("code"), F.lower("p_type").alias("name")
    ).distinct()
    return catalog.outlier_label(views.bare_topic(spark, sf), taxonomy).select("id", "model", "llm_label")


@query("""SELECT id, 'topic' AS kind, name FROM topic UNION ALL SELECT id, 'category', name FROM category""",
       "topic category")
def concat_frames(spark, sf):
    topics = views.bare_topic(spark, sf).select("id", F.lit("topic").alias("kind"), "name")
    categories = views.bare_category(spark, sf).select("id", F.lit("category").alias("kind"), "name")
    return catalog.concat_frames([topics, categories])


@query("""SELECT DISTINCT id FROM (
            SELECT p.id, row_number() OVER (PARTITION BY c.archive ORDER BY p.abstract_length DESC, p.id, c.id) AS rn,
                   floor(a.n * 36 / 100) AS quota
            FROM paper p JOIN paper_categories pc ON pc.paper_id = p.id JOIN category c ON c.id = pc.category_id
            JOIN (SELECT archive, sum(paper_count) AS n FROM category GROUP BY archive) a ON a.archive = c.archive)
          WHERE rn <= quota""", "paper category")
def sample_by_archive(spark, sf):
    return selection.sample_by_archive(
        views.paper(spark, sf), views.paper_categories(spark, sf), views.category(spark, sf), 36
    )


@query("""SELECT id FROM (
            SELECT p.id, y.n, row_number() OVER (PARTITION BY p.creation_year ORDER BY abstract_length DESC, p.id) AS rn
            FROM paper p JOIN (SELECT creation_year, count(*) AS n FROM paper GROUP BY 1) y USING (creation_year)
            WHERE p.id NOT IN (SELECT paper_id FROM paper_topics pt JOIN topic t ON t.id = pt.topic_id
                               WHERE t.hierarchy = 0 AND t.orig_id <> -1))
          WHERE rn <= floor(n * 1 / 100)""", "paper topic")
def sample_outliers_by_year(spark, sf):
    return selection.sample_outliers_by_year(
        views.paper(spark, sf), views.paper_topics(spark, sf), views.bare_topic(spark, sf), 0, 1
    )


@query("""SELECT paper_id AS id, CASE WHEN max(several) > 1 THEN -1 ELSE min(topic_id) END AS topic_id FROM (
            SELECT pt.paper_id, pt.topic_id, t.paper_count,
                   row_number() OVER (PARTITION BY pt.topic_id ORDER BY probability DESC, paper_id) AS rn,
                   count(*) OVER (PARTITION BY pt.paper_id) AS several
            FROM paper_topics pt JOIN topic t ON t.id = pt.topic_id WHERE t.hierarchy = 0 AND t.orig_id <> -1)
          WHERE rn <= floor(paper_count * 36 / 100) GROUP BY paper_id""", "topic")
def sample_by_topic(spark, sf):
    return selection.sample_by_topic(views.paper_topics(spark, sf), views.topic(spark, sf), 0, 36)


@query("SELECT creation_year, count(*) AS paper_count FROM paper GROUP BY creation_year", "paper")
def papers_per_year(spark, sf):
    return selection.papers_per_year(views.paper(spark, sf))


@query("""SELECT x.source_id AS source_id, x.title AS title FROM (
            SELECT source_id, title, row_number() OVER (PARTITION BY title ORDER BY abstract_length DESC, id) AS rn
            FROM paper) x WHERE rn = 1""", "paper")
def dedup_by_key(spark, sf):
    from trendloom.operators.ranking import dedup_by_key as dedup

    return dedup(
        views.paper(spark, sf), ["title"], [F.desc("abstract_length"), F.asc("id")]
    ).select("source_id", "title")
