"""The given tables in the shape of the data model, in Spark and as SQL views.

Orders stand for papers, parts for categories (type and brand) and topics (brand), line items
for the links between them; documents are abstracts whose source is their topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.plans.registry import view
from trendloom.session import TASK_ROWS, settle, tasks_for


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that came in fewer pieces than there are cores, as one small file does."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


view("paper", """
SELECT o_orderkey AS id, 'p' || CAST(o_orderkey AS VARCHAR) AS source_id,
       CAST(year(o_orderdate) AS INT) AS creation_year, CAST(month(o_orderdate) AS INT) AS creation_month,
       o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN ' (Formula)' ELSE '' END AS title,
       CAST(floor(o_totalprice) AS INT) AS abstract_length, CAST(o_orderdate AS DATE) AS update_date
FROM orders""")


def paper(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("o_orderstatus") == "P", " (Formula)").otherwise("")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("source_id"),
        F.year("o_orderdate").alias("creation_year"),
        F.month("o_orderdate").alias("creation_month"),
        F.concat("o_orderpriority", mark).alias("title"),
        F.floor("o_totalprice").cast("int").alias("abstract_length"),
        F.col("o_orderdate").cast("date").alias("update_date"),
    )


view("lp", """
SELECT l_orderkey AS paper_id, l_linenumber, l_discount, l_returnflag,
       p_type || '.' || substr(p_brand, 7) AS name,
       CAST(ascii(p_type) * 10000 + length(p_type) * 100 + CAST(substr(p_brand, 7) AS INT) AS BIGINT) AS category_id,
       CAST(substr(p_brand, 7) AS INT) - 2 AS orig_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey""")


def _brand() -> Column:
    return F.substring("p_brand", 7, 9).cast("int")


def _category_id() -> Column:
    return (F.ascii("p_type") * 10000 + F.length("p_type") * 100 + _brand()).cast("bigint")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their part, dealt by paper into tasks of bounded size, so that what groups or
    joins by paper needs no further shuffle."""
    lines = load(spark, sf, "lineitem")
    tasks = tasks_for(spark, lines.count())  # from the file's footer
    parts = load(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(".", "p_type", F.substring("p_brand", 7, 9)).alias("name"),
        _category_id().alias("category_id"),
        (_brand() - 2).alias("orig_id"),
    )
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    if parts.count() > TASK_ROWS:
        lines = lines.repartition(tasks, "l_partkey")
    return (
        lines.join(parts, "l_partkey")
        .repartition(tasks, "l_orderkey")
        .join(orders, "l_orderkey", "left_semi")
        .withColumnRenamed("l_orderkey", "paper_id")
    )


view("category", """
SELECT CAST(ascii(p_type) * 10000 + length(p_type) * 100 + CAST(substr(p_brand, 7) AS INT) AS BIGINT) AS id,
       p_type AS archive, p_type || '.' || substr(p_brand, 7) AS name,
       CAST((SELECT count(*) FROM paper_categories pc WHERE pc.category_id
             = ascii(p_type) * 10000 + length(p_type) * 100 + CAST(substr(p_brand, 7) AS INT)) AS BIGINT) AS paper_count
FROM (SELECT DISTINCT p_type, p_brand FROM part)""", "paper_categories")

view("paper_categories", """
SELECT paper_id, category_id, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS is_primary
FROM lp GROUP BY paper_id, category_id""", "lp")


def bare_category(spark: SparkSession, sf: str) -> DataFrame:
    """Categories before their papers are counted."""
    return (
        load(spark, sf, "part")
        .select("p_type", "p_brand")
        .distinct()
        .select(
            _category_id().alias("id"),
            F.col("p_type").alias("archive"),
            F.concat_ws(".", "p_type", F.substring("p_brand", 7, 9)).alias("name"),
            F.lit(0).cast("bigint").alias("paper_count"),
        )
    )


def paper_categories(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _links(spark, sf)
        .groupBy("paper_id", "category_id")
        .agg(F.max((F.col("l_linenumber") == 1).cast("int")).alias("is_primary"))
    )


def category(spark: SparkSession, sf: str) -> DataFrame:
    from trendloom.operators.catalog import category_paper_count

    return category_paper_count(bare_category(spark, sf), paper_categories(spark, sf))


view("m0_links", """
SELECT paper_id, CAST(orig_id + 2 AS BIGINT) AS topic_id, orig_id, max(1 - l_discount) AS probability,
       min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS transformed
FROM lp GROUP BY paper_id, orig_id""", "lp")

view("paper_topics", """
SELECT paper_id, topic_id, probability, transformed FROM m0_links
UNION ALL
SELECT paper_id, CAST(100 + orig_id // 5 AS BIGINT), max(probability), min(transformed)
FROM m0_links WHERE orig_id >= 0 GROUP BY paper_id, orig_id // 5""", "m0_links")


def m0_links(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return (
        _links(spark, sf)
        .groupBy("paper_id", "orig_id")
        .agg(
            F.max(1 - F.col("l_discount")).alias("probability"),
            F.min(F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)).alias("transformed"),
        )
        .select(
            "paper_id", (F.col("orig_id") + 2).cast("bigint").alias("topic_id"),
            "orig_id", "probability", "transformed",
        )
    )


def paper_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments to the brand topics (model m0) and to their groups of five (model m1)."""
    flag, brand = F.col("l_returnflag"), F.col("orig_id")
    fine = F.struct(F.lit("m0").alias("model"), (brand + 2).cast("bigint").alias("topic_id"))
    coarse = F.struct(F.lit("m1").alias("model"), (F.floor(brand / 5) + 100).cast("bigint").alias("topic_id"))
    return (
        _links(spark, sf)
        .select(
            "paper_id",
            F.inline(F.when(brand >= 0, F.array(fine, coarse)).otherwise(F.array(fine))),
            (1 - F.col("l_discount")).alias("sure"),
            F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("way"),
        )
        .groupBy("paper_id", "model", "topic_id")
        .agg(F.max("sure").alias("probability"), F.min("way").alias("transformed"))
        .drop("model")
    )


view("bare_topic", """
SELECT CAST(b AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 0 AS hierarchy, 'm0' AS model, b - 2 AS orig_id,
       CAST(b - 2 AS VARCHAR) || '_brand' AS name, CASE WHEN b >= 20 THEN '' ELSE 'Brand#' || CAST(b AS VARCHAR) END AS llm_label
FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS b FROM part)
UNION ALL
SELECT DISTINCT CAST(100 + (b - 2) // 5 AS BIGINT), CAST(NULL AS BIGINT), 1, 'm1', (b - 2) // 5,
       CAST((b - 2) // 5 AS VARCHAR) || '_group', 'Group ' || CAST((b - 2) // 5 AS VARCHAR)
FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS b FROM part) WHERE b >= 2
UNION ALL
SELECT DISTINCT CAST(1000 + ascii(p_type) * 10 + length(p_type) AS BIGINT), CAST(NULL AS BIGINT), -1, 'subset_' || p_type, -1,
       '-1_subset', 'Outliers'
FROM part""")

view("topic", """
SELECT t.id, parent_id, hierarchy, model, orig_id, name, llm_label, CAST(coalesce(n, 0) AS BIGINT) AS paper_count
FROM bare_topic t LEFT JOIN (SELECT topic_id, count(*) AS n FROM paper_topics GROUP BY topic_id) c ON c.topic_id = t.id
""", "bare_topic", "paper_topics")


def bare_topic(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part")
    b = F.col("b")
    brands = parts.select(_brand().alias("b")).distinct()
    nothing = F.lit(None).cast("bigint").alias("parent_id")
    fine = brands.select(
        b.cast("bigint").alias("id"), nothing, F.lit(0).alias("hierarchy"), F.lit("m0").alias("model"),
        (b - 2).alias("orig_id"), F.concat((b - 2).cast("string"), F.lit("_brand")).alias("name"),
        F.when(b >= 20, "").otherwise(F.concat(F.lit("Brand#"), b.cast("string"))).alias("llm_label"),
    )
    group = F.floor((b - 2) / 5).cast("int")
    coarse = brands.filter(b >= 2).select(
        (group + 100).cast("bigint").alias("id"), nothing, F.lit(1).alias("hierarchy"), F.lit("m1").alias("model"),
        group.alias("orig_id"), F.concat(group.cast("string"), F.lit("_group")).alias("name"),
        F.concat(F.lit("Group "), group.cast("string")).alias("llm_label"),
    ).distinct()
    subsets = parts.select(
        (F.lit(1000) + F.ascii("p_type") * 10 + F.length("p_type")).cast("bigint").alias("id"), nothing,
        F.lit(-1).alias("hierarchy"), F.concat(F.lit("subset_"), "p_type").alias("model"),
        F.lit(-1).alias("orig_id"), F.lit("-1_subset").alias("name"), F.lit("Outliers").alias("llm_label"),
    ).distinct()
    # a stored table in use: its size is known, so that links join it without a shuffle
    return settle(fine.unionByName(coarse).unionByName(subsets).withColumn("paper_count", F.lit(0).cast("bigint")))


def topic(spark: SparkSession, sf: str) -> DataFrame:
    from trendloom.operators.catalog import topic_paper_count

    return settle(topic_paper_count(bare_topic(spark, sf), paper_topics(spark, sf)))


view("paper_vectors", """
SELECT p.*, e.embedding FROM paper p LEFT JOIN embeddings e ON e.vec_id = p.id""", "paper")


def paper_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with an embedding where one exists for their id."""
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return paper(spark, sf).join(vectors, "id", "left")


view("docs", """
SELECT doc_id, CASE WHEN n_chars < 300 THEN -1 ELSE CAST(substr(source, 4) AS INT) END AS topic_id, text
FROM documents""")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their source as topic; short ones are outliers."""
    return spread(load(spark, sf, "documents")).select(
        "doc_id",
        F.when(F.col("n_chars") < 300, -1)
        .otherwise(F.substring("source", 4, 9).cast("int"))
        .alias("topic_id"),
        "text",
    )


view("snapshot", """
SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, lang || ' ' || source AS title, ' ' || text AS abstract,
       lang || '.' || source || ' ' || source || ' ' || lang || ' x.' || lang AS categories,
       CASE WHEN n_chars % 97 = 0 THEN NULL ELSE CAST('1998-01-01' AS DATE) + CAST(doc_id * 37 % 5000 AS INT) END AS creation_date,
       CAST('2012-01-01' AS DATE) + CAST(n_chars % 700 AS INT) AS update_date
FROM documents""")


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as metadata records; dates are made up from their columns."""
    created = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("doc_id") * 37 % 5000).cast("int"))
    stamp = F.concat(F.date_format(created, "E, d MMM yyyy"), F.lit(" 19:18:42 GMT"))
    undated = F.col("n_chars") % 97 == 0
    later = F.struct(F.lit("v2").alias("version"), F.lit("Mon, 2 Apr 2012 19:18:42 GMT").alias("created"))
    first = F.struct(F.when(undated, "v3").otherwise("v1").alias("version"), stamp.alias("created"))
    return spread(load(spark, sf, "documents")).select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.concat(F.lit(" "), "text").alias("abstract"),
        F.concat(
            "lang", F.lit("."), "source", F.lit(" "), "source", F.lit(" "), "lang", F.lit(" x."), "lang"
        ).alias("categories"),
        F.array(later, first).alias("versions"),
        F.date_add(F.lit("2012-01-01").cast("date"), (F.col("n_chars") % 700).cast("int"))
        .cast("string")
        .alias("update_date"),
    )
