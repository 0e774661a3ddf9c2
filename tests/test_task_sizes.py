from pyspark.sql import functions as F

from trendloom import session
from trendloom.operators import mutations
from trendloom.plans import views


def test_links_are_dealt_into_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    keys = spark.range(4000)
    keys.select((F.col("id") % 800).alias("o_orderkey")).distinct().write.parquet(f"{tmp_path}/orders.parquet")
    keys.limit(50).select(
        F.col("id").alias("p_partkey"), F.lit("ECONOMY").alias("p_type"),
        F.concat(F.lit("Brand#"), (F.col("id") % 25).cast("string")).alias("p_brand"),
    ).write.parquet(f"{tmp_path}/part.parquet")
    keys.select(
        (F.col("id") % 800).alias("l_orderkey"), (F.col("id") * 7 % 50).alias("l_partkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") % 10 / 100).alias("l_discount"),
        F.lit("A").alias("l_returnflag"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    links = views.paper_topics(spark, str(tmp_path))
    sizes = links.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(sizes) >= 20 and max(r["count"] for r in sizes) <= 4 * 100 * 2
    assert links.filter("topic_id < 100").count() == keys.select(F.col("id") % 800, F.col("id") * 7 % 50 % 25).distinct().count()


def test_new_links_are_dealt_too(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    links = spark.range(3000).selectExpr("id AS paper_id", "id % 5 AS topic_id", "0.5D AS probability", "0 AS transformed")
    topic = spark.range(5).selectExpr("id", "'m' AS model", "cast(id AS int) AS orig_id", "0L AS paper_count")
    given = links.filter("paper_id < 1000").localCheckpoint()
    counts, merged = mutations.import_assignments(topic, given, "m", links.drop("transformed"))
    assert merged.count() == 3000 and {r["paper_count"] for r in counts.collect()} == {600}
    fresh = merged.filter("transformed = 1")
    assert len(fresh.inputFiles()) >= 20
