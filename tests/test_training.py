import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import catalog, topics
from trendloom.plans import training
from trendloom.schemas import CATEGORY, PAPER_CATEGORIES, PAPER_TOPICS, TOPIC, TOPIC_STATS


@pytest.fixture(scope="module")
def papers(spark):
    """Three groups of near vectors whose words differ, and two papers far from all."""
    rng = np.random.default_rng(2)
    words = ["cats purr loudly", "dogs bark outside", "trains run late"]
    rows = []
    for i in range(24):
        centre = np.zeros(6)
        centre[i % 3] = 1
        rows.append((i, f"{words[i % 3]} number{i % 3}", [float(x) for x in centre + rng.normal(0, 0.02, 6)]))
    rows += [(24, "odd thing", [0.0] * 3 + [1.0, 0.0, 0.0]), (25, "other matter", [0.0] * 5 + [1.0])]
    return spark.createDataFrame(rows, "id long, abstract string, embedding array<double>")


SETTINGS = training.Settings(neighbours=5, min_samples=2, min_cluster_size=4, eps=0.1, top_words=3)


def test_train_assign_and_merge(spark, papers):
    store = [spark.createDataFrame([], s) for s in (TOPIC, PAPER_TOPICS, TOPIC_STATS)]
    first = papers.filter("id < 21 or id = 24")
    topic, links, _ = training.train_model(*store, first, "m", 0, SETTINGS)
    assert {(r.orig_id, r.paper_count) for r in topic.collect()} == {(-1, 1), (0, 7), (1, 7), (2, 7)}
    names = {r.orig_id: r.name for r in topic.collect()}
    assert any(w in names[0] for w in ("cats", "purr", "loudly", "number0"))
    same = training.train_model(topic, links, store[2], first, "m", 0, SETTINGS)
    assert same[0] is topic  # a model that exists stays

    docs = catalog.papers_by_model(first, links, topic, "m").selectExpr("id as doc_id", "orig_id as topic_id", "abstract as text")
    up, copied = training.agglomerate(first, topic, links, topics.term_counts(docs), "m", "above", 1, 9.0)
    above = [r for r in up.collect() if r.model == "above"]
    assert [(r.orig_id, r.hierarchy, r.paper_count) for r in above if r.paper_count] == [(0, 1, 21)]
    children = {r.orig_id: r.parent_id for r in up.collect() if r.model == "m"}
    merged = next(r.id for r in above if r.orig_id == 0)
    assert children == {-1: None, 0: merged, 1: merged, 2: merged}

    topic, links = training.transform_papers(papers, topic, links, "m", SETTINGS)
    orig = {r.id: r.orig_id for r in topic.collect()}
    held = {r.paper_id: (orig[r.topic_id], r.transformed) for r in links.collect()}
    assert [held[i] for i in (21, 22, 23, 25)] == [(0, 1), (1, 1), (2, 1), (-1, 1)]


def test_subsets(spark, papers):
    category = spark.createDataFrame([(1, "pets", "pets.cat", 16), (2, "rail", "rail", 8)], CATEGORY)
    links = spark.createDataFrame([(i, 2 if i % 3 == 2 else 1, 1) for i in range(24)], PAPER_CATEGORIES)
    store = [spark.createDataFrame([], s) for s in (TOPIC, PAPER_TOPICS, TOPIC_STATS)]
    topic, held = training.train_subset_models(papers, category, links, *store, 1000, 100, SETTINGS)
    counts = {}
    for r in topic.collect():
        counts.setdefault(r.model, []).append((r.orig_id, r.paper_count))
    assert {m: sorted(c) for m, c in counts.items()} == {"subset_pets": [(0, 8), (1, 8)], "subset_rail": [(0, 8)]}
    assert held.count() == 24


def test_sweep_and_selection(spark, papers):
    store = [spark.createDataFrame([], s) for s in (TOPIC, PAPER_TOPICS, TOPIC_STATS)]
    swept = training.Settings(
        neighbours=5, eps=0.1, top_words=3, sweep_samples=(2, 3), sweep_sizes=(2, 4, 9), min_clusters=3
    )
    chosen = papers.filter("id < 21 or id = 24").select("id")
    topic, links, _ = training.train_model(*store, papers, "m", 0, swept, selected=chosen)
    assert {(r.orig_id, r.paper_count) for r in topic.collect()} == {(-1, 1), (0, 7), (1, 7), (2, 7)}
    assert {r.paper_id for r in links.collect()} == {*range(21), 24}
    none = training.Settings(neighbours=5, eps=0.1, sweep_samples=(2,), sweep_sizes=(20,))
    with pytest.raises(ValueError):
        training.train_model(*store, papers, "m", 0, none)


def test_sweep_goes_on_with_fewer_clusters(spark, papers):
    """No setting has four clusters: an error, unless fewer will do."""
    store = [spark.createDataFrame([], s) for s in (TOPIC, PAPER_TOPICS, TOPIC_STATS)]
    chosen = papers.filter("id < 21 or id = 24").select("id")
    settings = training.Settings(
        neighbours=5, eps=0.1, top_words=3, sweep_samples=(2, 3), sweep_sizes=(2, 4, 9), min_clusters=4, strict=False
    )
    topic, _, _ = training.train_model(*store, papers, "m", 0, settings, selected=chosen)
    assert {(r.orig_id, r.paper_count) for r in topic.collect()} == {(-1, 1), (0, 7), (1, 7), (2, 7)}


def test_bits_assign_by_bits(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(24):
        signs = np.where(np.arange(32) // 11 == i % 3, 1.0, -1.0)
        signs[rng.integers(0, 32)] *= -1
        # lengths of single components lead cosine astray, bits do not see them
        rows.append((i, f"words {i % 3}", [float(x) for x in signs * np.where(np.arange(32) == 31, 500, 1)]))
    papers = spark.createDataFrame(rows, "id long, abstract string, embedding array<double>")
    store = [spark.createDataFrame([], s) for s in (TOPIC, PAPER_TOPICS, TOPIC_STATS)]
    bits = training.Settings(neighbours=5, min_samples=2, min_cluster_size=3, eps=6.0, top_words=3, binary=True)
    topic, links, _ = training.train_model(*store, papers.filter("id < 18"), "m", 0, bits)
    topic, links = training.transform_papers(papers, topic, links, "m", bits)
    group = {r.paper_id: r.topic_id for r in links.collect()}
    assert len(group) == 24 and all(group[i] == group[i % 3] for i in range(24)) and len(set(group.values())) == 3


def test_subsets_together_equal_one_by_one(spark, papers):
    """Also the names of topics, a subset without any cluster, and one that shares its papers."""
    category = spark.createDataFrame([(1, "pets", "pets.cat", 16), (2, "rail", "rail", 8), (3, "all", "all", 26), (4, "odd", "odd", 2)], CATEGORY)
    places = [(i, 2 if i % 3 == 2 else 1) for i in range(24)] + [(i, 3) for i in range(26)] + [(24, 4), (25, 4)]
    links = spark.createDataFrame([(i, c, 1) for i, c in places], PAPER_CATEGORIES)
    store = [spark.createDataFrame([], s) for s in (TOPIC, PAPER_TOPICS, TOPIC_STATS)]
    names = spark.createDataFrame([("odd", "Oddities")], "code string, name string")
    topic, held = training.train_subset_models(papers, category, links, *store, 1000, 100, SETTINGS, names)
    found = {(r.model, r.orig_id): (r.name, r.llm_label, r.paper_count) for r in topic.collect()}
    assert found["subset_odd", -1][1:] == ("Oddities", 2)
    assert found["subset_all", -1][1] == "all"
    for subset in ("pets", "rail", "all", "odd"):
        ids = {i for i, c in places if {1: "pets", 2: "rail", 3: "all", 4: "odd"}[c] == subset}
        alone = training.train(papers.filter(F.col("id").isin(list(ids))), SETTINGS)
        sizes = {r.topic_id: r["count"] for r in alone.assignments.groupBy("topic_id").count().collect()}
        want = {r.topic_id: (r.name, sizes[r.topic_id]) for r in alone.topics.collect()}
        assert {i: (n, c) for (m, i), (n, _, c) in found.items() if m == f"subset_{subset}"} == want
    again = training.train_subset_models(papers, category, links, topic, held, store[2], 1000, 100, SETTINGS)
    assert again[0].count() == topic.count() and again[1].count() == held.count()
