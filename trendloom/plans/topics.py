"""Queries that describe, compare, merge and distribute topics over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import hierarchy
from trendloom.operators import topics as ops
from trendloom.plans import views
from trendloom.plans.registry import query, view
from trendloom.session import settle, work_dir
from trendloom.sources import records

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

view("all_words", r"""
SELECT doc_id, topic_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM docs""", "docs")

view("tokens", f"""
SELECT doc_id, topic_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
  SELECT doc_id, topic_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM all_words) WHERE word NOT IN ({_STOP})""", "all_words")

view("doc_terms", """
SELECT doc_id, topic_id, term, count(*) AS n FROM (
  SELECT doc_id, topic_id, word AS term FROM tokens UNION ALL
  SELECT a.doc_id, a.topic_id, a.word || ' ' || b.word FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id AND b.i = a.i + 1)
GROUP BY ALL""", "tokens")

view("counts", """
SELECT topic_id, term, CAST(sum(n) AS BIGINT) AS tf FROM doc_terms GROUP BY ALL""", "doc_terms")

view("weights", """
SELECT topic_id, term, tf, ln(1 + a / f) AS idf, tf / size::DOUBLE * ln(1 + a / f) AS weight
FROM counts JOIN (SELECT topic_id, sum(tf) AS size FROM counts GROUP BY 1) USING (topic_id)
JOIN (SELECT term, CAST(sum(tf) AS DOUBLE) AS f FROM counts GROUP BY 1) USING (term),
     (SELECT CAST(floor(avg(size)) AS DOUBLE) AS a FROM (SELECT sum(tf) AS size FROM counts GROUP BY topic_id))""", "counts")

view("units", """
SELECT topic_id, term, weight / length AS unit FROM weights JOIN (
  SELECT topic_id, sqrt(sum(weight * weight)) AS length FROM weights GROUP BY 1) USING (topic_id) WHERE topic_id <> -1""", "weights")

view("top_terms", """
SELECT * FROM (SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank
               FROM weights) WHERE rank <= 10""", "weights")

view("similarity", """
SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, sum(a.unit * b.unit) AS similarity
FROM units a JOIN units b ON a.term = b.term AND a.topic_id < b.topic_id GROUP BY ALL""", "units")

# merging the closest pair again and again; a row per step, with the clusters that are left
view("merges", """
SELECT 0 AS step, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id, CAST(NULL AS BIGINT) AS parent_id,
       CAST([] AS BIGINT[]) AS topics, CAST(0 AS DOUBLE) AS d,
       (SELECT list({'node': CAST(topic_id AS BIGINT), 'w': CAST(0 AS DOUBLE), 'members': [CAST(topic_id AS BIGINT)]}) FROM merged_topics) AS clusters
UNION ALL
SELECT step + 1, l, r, top + step + 1, list_sort(list_concat(ml, mr)), d,
       list_append(list_filter(clusters, lambda c: c.node <> l AND c.node <> r),
                   {'node': top + step + 1, 'w': w, 'members': list_concat(ml, mr)})
FROM (
  SELECT *, row_number() OVER (ORDER BY d, l, r) AS place FROM (
    SELECT any_value(x.step) AS step, any_value(x.clusters) AS clusters, x.c.node AS l, y.c.node AS r,
           any_value(x.c.members) AS ml, any_value(y.c.members) AS mr, any_value(x.c.w) + any_value(y.c.w) + sum(e) AS w,
           round((2 * sum(e) - 2 * any_value(len(x.c.members) * len(y.c.members)
             * (x.c.w / len(x.c.members) ** 2 + y.c.w / len(y.c.members) ** 2)))
             / any_value(len(x.c.members) + len(y.c.members)), 12) AS d
    FROM (SELECT step, clusters, unnest(clusters) AS c FROM merges) x
    JOIN (SELECT unnest(clusters) AS c FROM merges) y ON x.c.node < y.c.node
    JOIN topic_squares p ON list_contains(x.c.members, p.a) AND list_contains(y.c.members, p.b)
    GROUP BY x.c.node, y.c.node)), (SELECT CAST(max(topic_id) AS BIGINT) AS top FROM merged_topics)
WHERE place = 1""", "merged_topics", "topic_squares")

view("merged_topics", "SELECT DISTINCT topic_id FROM weights WHERE topic_id <> -1", "weights")

view("topic_squares", """
SELECT x.topic_id AS a, y.topic_id AS b, (1 - coalesce(similarity, 0)) ** 2 AS e
FROM merged_topics x JOIN merged_topics y ON x.topic_id <> y.topic_id
LEFT JOIN similarity ON topic_a = least(x.topic_id, y.topic_id) AND topic_b = greatest(x.topic_id, y.topic_id)""", "merged_topics", "similarity")

view("tree", """
SELECT parent_id, topics, left_id, right_id, round(sqrt(greatest(d, 0)), 9) AS distance FROM merges WHERE step > 0""", "merges")

view("runs", f"""
SELECT doc_id, run, list_filter(part, lambda x: x NOT IN ({_STOP})) AS p FROM (
  SELECT doc_id, run, list_slice(w, run, run + 3) AS part FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS run FROM all_words))""", "all_words")

view("run_terms", """
SELECT doc_id, run, term, count(*) AS n FROM (
  SELECT doc_id, run, unnest(p) AS term FROM runs UNION ALL
  SELECT doc_id, run, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) FROM runs) GROUP BY ALL""", "runs")

view("distribution", """
SELECT doc_id, topic_id, s / sum(s) OVER (PARTITION BY doc_id) AS probability FROM (
  SELECT doc_id, topic_id, sum(similarity) AS s FROM (
    SELECT doc_id, run, topic_id, dot / length AS similarity FROM (
      SELECT r.doc_id, r.run, u.topic_id, sum(r.n * idf * unit) AS dot
      FROM run_terms r JOIN (SELECT term, min(idf) AS idf FROM weights GROUP BY 1) i ON i.term = r.term
      JOIN units u ON u.term = r.term GROUP BY ALL)
    JOIN (SELECT r.doc_id, r.run, sqrt(sum((r.n * idf) * (r.n * idf))) AS length
          FROM run_terms r JOIN (SELECT term, min(idf) AS idf FROM weights GROUP BY 1) i ON i.term = r.term GROUP BY ALL)
    USING (doc_id, run)) WHERE similarity >= 0.1 GROUP BY ALL)""", "run_terms", "weights", "units")

view("sizes", "SELECT topic_id, count(*) AS size FROM docs GROUP BY 1", "docs")

# topics 0 to 4 and 5 to 9 merge; the numbers follow the sizes
view("renumbered", """
SELECT topic_id, new_id FROM (
  SELECT topic_id, CASE WHEN topic_id BETWEEN 0 AND 4 THEN 0 WHEN topic_id BETWEEN 5 AND 9 THEN 5 ELSE topic_id END AS lead FROM sizes)
JOIN (SELECT lead, CASE WHEN lead = -1 THEN -1 ELSE row_number() OVER (ORDER BY lead = -1, n DESC, lead) - 1 END AS new_id FROM (
        SELECT CASE WHEN topic_id BETWEEN 0 AND 4 THEN 0 WHEN topic_id BETWEEN 5 AND 9 THEN 5 ELSE topic_id END AS lead, sum(size) AS n
        FROM sizes GROUP BY 1)) USING (lead)""", "sizes")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.term_counts(views.docs(spark, sf))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return ops.c_tf_idf(_counts(spark, sf))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    """Sources in two groups of five, as topic lists."""
    proper = ops.topic_sizes(views.docs(spark, sf)).filter("topic_id between 0 and 9")
    group = F.floor(F.col("topic_id") / 5).alias("group_id")
    return proper.groupBy(group).agg(F.collect_list("topic_id").alias("topics"))


@query("SELECT doc_id, CAST(len(w) AS INT) AS n, array_to_string(w, ' ') AS words FROM all_words", "all_words")
def tokenize(spark, sf):
    found = text.words(F.col("text"))
    return views.docs(spark, sf).select("doc_id", F.size(found).alias("n"), F.array_join(found, " ").alias("words"))


@query("SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM tokens GROUP BY doc_id", "tokens")
def remove_stop_words(spark, sf):
    kept = text.remove_stop_words(text.words(F.col("text")))
    frame = views.docs(spark, sf).select("doc_id", F.array_join(kept, " ").alias("words"))
    return frame.filter(F.col("words") != "")


@query("SELECT doc_id, term, n FROM doc_terms", "doc_terms")
def ngrams(spark, sf):
    term = F.explode(text.terms(F.col("text"))).alias("term")
    return views.docs(spark, sf).select("doc_id", term).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("SELECT topic_id, term, tf FROM counts", "counts")
def class_documents(spark, sf):
    return _counts(spark, sf)


@query("SELECT term, count(*) AS topics, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term HAVING count(*) >= 3", "counts")
def vocabulary(spark, sf):
    return ops.vocabulary(_counts(spark, sf), 3)


@query("SELECT topic_id, term, tf, round(weight, 9) AS weight FROM weights", "weights")
def c_tf_idf(spark, sf):
    return _weights(spark, sf).select("topic_id", "term", "tf", F.round("weight", 9).alias("weight"))


@query("SELECT topic_id, term, round(weight, 9) AS weight, CAST(rank AS INT) AS rank FROM top_terms", "top_terms")
def top_words(spark, sf):
    return ops.top_words(_weights(spark, sf), 10).withColumn("weight", F.round("weight", 9))


@query("""SELECT topic_id, topic_id || '_' || string_agg(term, '_' ORDER BY rank) AS name FROM top_terms WHERE rank <= 4 GROUP BY topic_id""", "top_terms")
def topic_name(spark, sf):
    lists = ops.word_lists(ops.top_words(_weights(spark, sf), 10), 10)
    return lists.select("topic_id", text.topic_name(F.col("topic_id"), F.col("words")).alias("name"))


@query("SELECT topic_id, size FROM sizes", "sizes")
def topic_sizes(spark, sf):
    return ops.topic_sizes(views.docs(spark, sf))


@query("""SELECT s.topic_id, s.size, s.topic_id || '_' || first4 AS name, words FROM sizes s JOIN (
            SELECT topic_id, string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS first4, string_agg(term, ',' ORDER BY rank) AS words
            FROM top_terms GROUP BY topic_id) t ON t.topic_id = s.topic_id""", "sizes top_terms")
def topic_info(spark, sf):
    docs = views.docs(spark, sf)
    return ops.topic_info(docs, _weights(spark, sf)).withColumn("words", F.array_join("words", ","))


@query("""SELECT topic_id, CASE WHEN topic_id = -1 THEN -1 ELSE row_number() OVER (ORDER BY topic_id = -1, size DESC, topic_id) - 1 END AS new_id FROM sizes""", "sizes")
def rank_topics_by_size(spark, sf):
    return ops.rank_topics_by_size(ops.topic_sizes(views.docs(spark, sf)))


@query("SELECT CAST(topic_a AS BIGINT) AS topic_a, CAST(topic_b AS BIGINT) AS topic_b, round(similarity, 9) AS similarity FROM similarity", "similarity")
def topic_similarity(spark, sf):
    return ops.topic_similarity(_weights(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query("""SELECT t.topic_id, term, round(weight, 9) AS weight, CAST(rank AS INT) AS rank FROM top_terms t
          WHERE rank <= 5 AND t.topic_id IN (SELECT topic_id FROM sizes WHERE topic_id <> -1 ORDER BY size DESC, topic_id LIMIT 8)""", "top_terms sizes")
def topic_barchart_data(spark, sf):
    data = ops.topic_barchart_data(views.docs(spark, sf), _weights(spark, sf))
    return data.withColumn("weight", F.round("weight", 9))


@query("SELECT CAST(new_id AS BIGINT) AS topic_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM counts JOIN renumbered USING (topic_id) GROUP BY ALL", "counts renumbered")
def merge_topics(spark, sf):
    mapping = ops.merge_map(ops.topic_sizes(views.docs(spark, sf)), _groups(spark, sf))
    return ops.merge_counts(_counts(spark, sf), mapping)


@query("""SELECT a.nation AS group_id, a.topic_id, CAST(b.n AS BIGINT) AS listed
          FROM (SELECT DISTINCT c_nationkey AS nation, length(c_mktsegment) AS topic_id FROM customer) a
          JOIN (SELECT length(c_mktsegment) AS topic_id, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1) b USING (topic_id)""")
def explode_topics(spark, sf):
    groups = views.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("group_id")).agg(
        F.collect_set(F.length("c_mktsegment").cast("bigint")).alias("topics")
    )
    return ops.explode_topics(groups)


@query("SELECT doc_id, topic_id, round(probability, 9) AS probability FROM distribution", "distribution")
def approximate_distribution(spark, sf):
    docs = views.docs(spark, sf)
    return ops.approximate_distribution(docs, _weights(spark, sf)).withColumn("probability", F.round("probability", 9))


@query("SELECT doc_id, topic_id, round(probability, 9) AS probability FROM distribution WHERE probability > 0.15", "distribution")
def min_similarity(spark, sf):
    docs = views.docs(spark, sf)
    kept = ops.min_similarity(ops.approximate_distribution(docs, _weights(spark, sf)))
    return kept.withColumn("probability", F.round("probability", 9))


@query("""SELECT d.doc_id, CASE WHEN d.topic_id = -1 AND p.probability >= 0.08 THEN p.topic_id ELSE d.topic_id END AS topic_id
          FROM docs d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, topic_id) AS rn FROM distribution) p
            ON p.doc_id = d.doc_id AND p.rn = 1""", "docs distribution")
def reduce_outliers(spark, sf):
    docs = views.docs(spark, sf)
    mix = ops.approximate_distribution(docs, _weights(spark, sf))
    return ops.reduce_outliers(docs, mix, 0.08)


@query("""UNPIVOT (SELECT o_orderkey AS doc_id, o_totalprice AS "0", o_totalprice / 2 AS "1", length(o_orderpriority)::DOUBLE AS "2" FROM orders)
          ON "0", "1", "2" INTO NAME topic VALUE probability""")
def unpivot_distribution(spark, sf):
    wide = views.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("0"), (F.col("o_totalprice") / 2).alias("1"),
        F.length("o_orderpriority").cast("double").alias("2"),
    )
    return ops.unpivot_distribution(wide).select("doc_id", F.col("topic_id").cast("string").alias("topic"), "probability")


view("closest", """
SELECT topic_id, doc_id, similarity, row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, doc_id) AS rn FROM (
  SELECT topic_id, doc_id, round(dot / length, 9) AS similarity FROM (
    SELECT topic_id, doc_id, sum(n * idf * weight) / sqrt(sum(n * idf * n * idf)) AS dot
    FROM doc_terms JOIN weights USING (topic_id, term) GROUP BY ALL)
  JOIN (SELECT topic_id, sqrt(sum(weight * weight)) AS length FROM weights GROUP BY 1) USING (topic_id))""", "doc_terms", "weights")


@query("SELECT topic_id, doc_id, similarity FROM closest WHERE rn <= 5", "closest")
def representative_documents(spark, sf):
    return ops.representative_documents(views.docs(spark, sf), _weights(spark, sf))


PROMPT = "Articles:\n[DOCUMENTS]Keywords: [KEYWORDS]. Label?"


@query("""SELECT topic_id, 'Articles:' || chr(10) || d || 'Keywords: ' || k || '. Label?' AS prompt
          FROM (SELECT topic_id, string_agg('- ' || text || chr(10), '' ORDER BY rn) AS d FROM closest JOIN documents USING (doc_id) WHERE rn <= 5 GROUP BY 1)
          JOIN (SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS k FROM top_terms GROUP BY 1) USING (topic_id)""", "closest top_terms")
def label_documents(spark, sf):
    return ops.label_documents(views.docs(spark, sf), _weights(spark, sf), PROMPT)


@query()
def mmr_keywords(spark, sf):
    return ops.mmr_keywords(_weights(spark, sf))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    weights = _weights(spark, sf)
    return hierarchy.topic_hierarchy(weights.select("topic_id"), ops.topic_similarity(weights))


def _shown(tree: DataFrame) -> DataFrame:
    """The smaller number on the left, lists as text."""
    return tree.select(
        "parent_id",
        F.array_join(F.transform("topics", lambda t: t.cast("string")), ",").alias("topics"),
        F.least("left_id", "right_id").alias("left_id"),
        F.greatest("left_id", "right_id").alias("right_id"),
        F.round("distance", 9).alias("distance"),
    )


@query("SELECT parent_id, array_to_string(topics, ',') AS topics, left_id, right_id, distance FROM tree", "tree", recursive=True)
def topic_hierarchy(spark, sf):
    return _shown(_tree(spark, sf))


# half of the merges are close: the bound lies between the two in the middle
MIDDLE = "SELECT median(distance) AS bound FROM tree"


@query(f"""SELECT parent_id, array_to_string(topics, ',') AS topics, left_id, right_id, distance FROM tree, ({MIDDLE}) WHERE distance < bound
           AND parent_id NOT IN (SELECT unnest([left_id, right_id]) FROM tree, ({MIDDLE}) WHERE distance < bound)""", "tree", recursive=True)
def maximal_merges(spark, sf):
    """Groups of topics below the median distance of all merges."""
    tree = settle(_tree(spark, sf).withColumn("distance", F.round("distance", 9)))
    bound = tree.agg(F.median("distance")).first()[0]
    return _shown(ops.maximal_merges(tree, bound or 0.0))


@query("""SELECT form, parent_id, array_to_string(topics, ',') AS topics, left_id, right_id, distance
          FROM tree, (SELECT unnest(['parquet', 'tsv']) AS form)""", "tree", recursive=True)
def topic_tree(spark, sf):
    """The merge tree as it is read back from each kind of file."""
    tree, found = settle(_tree(spark, sf)), []
    for form in ("parquet", "tsv"):
        path = work_dir(spark, "tree")
        records.write_topic_tree(tree, path, form)
        found.append(_shown(records.read_topic_tree(spark, path, form)).withColumn("form", F.lit(form)))
    return found[0].unionByName(found[1])


@query("""SELECT CAST(topic_a AS BIGINT) AS left_id, CAST(topic_b AS BIGINT) AS right_id, round(1 - similarity, 9) AS distance
          FROM similarity WHERE 1 - similarity < 0.5""", "similarity")
def max_cluster_distance(spark, sf):
    """Pairs of topics closer than a distance, as if each were a merge."""
    pairs = ops.topic_similarity(_weights(spark, sf)).select(
        F.col("topic_a").alias("left_id"), F.col("topic_b").alias("right_id"), (1 - F.col("similarity")).alias("distance")
    )
    return ops.max_cluster_distance(pairs, 0.5).withColumn("distance", F.round("distance", 9))


@query("""SELECT 'similarity' AS part, CAST(topic_a AS BIGINT) AS first, CAST(topic_b AS BIGINT) AS second, NULL::VARCHAR AS words, round(similarity, 9) AS value FROM similarity
          UNION ALL SELECT 'barchart', CAST(topic_id AS BIGINT), CAST(rank AS BIGINT), term, round(weight, 9) FROM top_terms
            WHERE rank <= 5 AND topic_id IN (SELECT topic_id FROM sizes WHERE topic_id <> -1 ORDER BY size DESC, topic_id LIMIT 8)
          UNION ALL SELECT 'hierarchy', left_id, right_id, array_to_string(topics, ','), distance FROM tree""", "similarity top_terms sizes tree", recursive=True)
def evaluate_model(spark, sf):
    """The data of all three figures, one below the other."""
    docs = views.docs(spark, sf)
    parts = hierarchy.evaluate_model(docs, _weights(spark, sf), True, True, True)

    def rows(part: str, first: str, second: str, words, value: str) -> DataFrame:
        numbers = (F.col(c).cast("bigint").alias(n) for c, n in ((first, "first"), (second, "second")))
        return parts[part].select(
            F.lit(part).alias("part"), *numbers, words.cast("string").alias("words"), F.round(value, 9).alias("value")
        )

    heat = rows("similarity", "topic_a", "topic_b", F.lit(None), "similarity")
    bars = rows("barchart", "topic_id", "rank", F.col("term"), "weight")
    parts["hierarchy"] = _shown(parts["hierarchy"])
    return heat.unionByName(bars).unionByName(rows("hierarchy", "left_id", "right_id", F.col("topics"), "distance"))
