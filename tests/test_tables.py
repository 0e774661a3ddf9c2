from pyspark.sql import functions as F

from trendloom.operators import catalog, mutations, ranking, selection
from trendloom.schemas import PAPER_TOPICS, TOPIC, TOPIC_STATS
from trendloom.sources import records, tables


def topic_row(i, model, orig, level=0, parent=None):
    return (i, parent, level, model, orig, f"{orig}_w", "", 0)


def test_ranks_do_not_need_whole_groups(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", i * 7919 % 101) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, g string, v int")
    found = {r.id: r["rank"] for r in ranking.rank_in_groups(frame, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    for group in {g for _, g, _ in rows}:
        order = sorted((r for r in rows if r[1] == group), key=lambda r: (-r[2], r[0]))
        assert [found[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_sample_sizes(spark):
    topic = spark.createDataFrame([(1, None, 0, "m", 0, "", "", 10), (2, None, 0, "m", 1, "", "", 1)], TOPIC)
    links = spark.createDataFrame([(p, 1, p / 10, 0) for p in range(10)] + [(9, 2, 0.1, 0)], PAPER_TOPICS)
    sizes = [selection.sample_by_topic(links, topic, 0, pct).count() for pct in (36, 0, 100)]
    assert sizes == [3, 10, 10]
    seeds = {r.id: r.topic_id for r in selection.sample_by_topic(links, topic, 0, 100).collect()}
    assert seeds[9] == -1 and seeds[0] == 1


def test_import_hierarchy_delete(spark):
    topic, links = spark.createDataFrame([], TOPIC), spark.createDataFrame([], PAPER_TOPICS)
    described = spark.createDataFrame([(o, f"{o}_w", "") for o in (-1, 0, 1)], "topic_id int, name string, llm_label string")
    rows = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, -1, 0.0), (1, 0, 0.1)], "paper_id long, topic_id int, probability double")
    topic, links = mutations.import_topics(topic, links, 0, "child", described, rows)
    assert {(r.orig_id, r.paper_count) for r in topic.collect()} == {(-1, 1), (0, 2), (1, 1)}
    assert {(r.paper_id, r.probability) for r in links.collect()} == {(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.0)}

    again = mutations.import_assignments(topic, links, "child", rows, distributed=True)[1]
    assert again.count() == links.count()  # known pairs stay

    parents = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0), (4, 1, 1.0)], "paper_id long, topic_id int, probability double")
    topic, links = mutations.import_topics(topic, links, 1, "parent", described.filter("topic_id >= 0"), parents)
    topic, links = mutations.update_hierarchy(topic, links, "child", "parent")
    up = {(r.model, r.orig_id): r.parent_id for r in topic.collect()}
    ids = {(r.model, r.orig_id): r.id for r in topic.collect()}
    assert up[("child", 0)] == ids[("parent", 0)] and up[("child", 1)] == ids[("parent", 1)]
    assert up[("child", -1)] is None

    stats = spark.createDataFrame([(i, 2000, 1, 1, 1, 1.0, None) for i in ids.values()], TOPIC_STATS)
    topic, links, stats = mutations.delete_model(topic, links, stats, "parent")
    left = topic.collect()
    assert {r.model for r in left} == {"child"} and all(r.parent_id is None for r in left)
    kept = {r.id for r in left}
    assert {r.topic_id for r in links.collect()} <= kept and {r.topic_id for r in stats.collect()} == kept


def test_majority_parent(spark):
    topic = spark.createDataFrame([topic_row(1, "c", 0), topic_row(8, "p", 0, 1), topic_row(9, "p", 1, 1)], TOPIC)
    links = spark.createDataFrame(
        [(p, 1, 1.0, 0) for p in range(3)] + [(0, 8, 1.0, 0), (1, 9, 1.0, 0), (2, 9, 1.0, 0)], PAPER_TOPICS
    )
    assert [tuple(r) for r in catalog.parent_topic(links, topic, "c", "p").collect()] == [(1, 9, 2)]


def test_versions_of_a_table(spark, tmp_path):
    root = str(tmp_path)
    assert tables.read_table(spark, root, "paper_topics").isEmpty()
    one = spark.createDataFrame([(1, 1, 0.5, 0)], PAPER_TOPICS)
    tables.write_table(one, root, "paper_topics")
    tables.write_table(one.withColumn("paper_id", F.lit(2)), root, "paper_topics", "append")
    current = tables.read_table(spark, root, "paper_topics")
    assert current.count() == 2
    tables.write_table(current.filter("paper_id = 2"), root, "paper_topics")
    assert [r.paper_id for r in tables.read_table(spark, root, "paper_topics").collect()] == [2]


def test_taxonomy_and_tree(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"cs": {"name": "Computing"}, "math": {"name": "Mathematics"}}')
    (tmp_path / "two.json").write_text('{"cs": {"name": "Other"}, "cs.AI": {"name": "Intelligence", "start_date": [1993, 1]}}')
    found = records.read_taxonomy(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert {tuple(r) for r in found.collect()} == {("cs", "Computing"), ("math", "Mathematics"), ("cs.AI", "Intelligence")}
    tree = spark.createDataFrame([(3, [0, 1], 0, 1, 0.25), (4, [0, 1, 2], 3, 2, 1.5)], records.TREE)
    for form in ("parquet", "tsv"):
        records.write_topic_tree(tree, str(tmp_path / form), form)
        back = records.read_topic_tree(spark, str(tmp_path / form), form)
        assert {str(r) for r in back.collect()} == {str(r) for r in tree.collect()}
