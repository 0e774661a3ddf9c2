import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendloom import parcels
from trendloom.functions import text
from trendloom.operators import topics

LINES = [
    (1, 0, "alpha beta alpha beta gamma"), (2, 0, "beta the gamma"), (3, -1, "alpha"), (4, 1, None), (5, None, "beta gamma"),
    (6, 1, "the of"), (7, 1, "größe alpha größe beta"),
]


def _docs(spark):
    return spark.createDataFrame(LINES, "doc_id bigint, topic_id int, text string").repartition(3)


def _shuffled(frame):
    """The plans of all row shuffles that hold a column of terms."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "term" in x]


def test_parcels_hold_every_row(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("t"), F.col("id") % 700).alias("term"), (F.col("id") / 7).alias("x"))
    found = parcels.meet(parcels.deal(rows, ["term"], 9), lambda t: t, "id bigint, term string, x double")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    sizes = parcels.meet(
        parcels.deal(rows, ["term"], 9), lambda t: pa.table({"n": [len(set(t["term"].to_pylist()))]}), "n bigint"
    ).collect()
    assert len(sizes) == 9 and sum(r["n"] for r in sizes) == 700


@pytest.mark.parametrize("start, end", [(1, 1), (1, 2), (2, 3)])
def test_counts_of_terms_are_those_of_rows(spark, monkeypatch, start, end):
    docs = _docs(spark)
    term = F.explode(text.terms(F.col("text"), start, end)).alias("term")
    want = docs.select("topic_id", term).groupBy("topic_id", "term").agg(F.count("*").alias("tf"))
    for limit in (1 << 23, 30):
        monkeypatch.setattr(topics, "COUNT_BYTES", limit)
        found = topics.term_counts(docs, start, end)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_terms_travel_in_parcels(spark):
    counts = topics.term_counts(_docs(spark))
    weights = topics.c_tf_idf(counts)
    for frame in (counts, weights, topics.topic_similarity(weights)):
        assert not _shuffled(frame)
    # tables of a row per topic go to the weights
    for frame in (weights, topics.mmr_keywords(weights)):
        assert "SortMergeJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    # a packed term takes a few bytes
    names = sorted(f"w{i % 300} w{i % 7919}" for i in range(20000))
    assert len(parcels.packed(pa.table({"topic_id": np.zeros(20000, dtype=int), "term": names, "tf": np.ones(20000, dtype=int)}))) < 6 * 20000


def test_products_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    cells = rng.permutation(60 * 9)[:200]
    rows = pa.table({"topic_id": cells % 9 * 5, "term": [f"t{c // 9}" for c in cells], "unit": rng.random(200)})
    matrix = np.zeros((60, 9))
    matrix[cells // 9, cells % 9] = rows["unit"].to_numpy()
    for limit in (1 << 21, 20):
        monkeypatch.setattr(topics, "CELLS", limit)
        found = {(r["topic_a"], r["topic_b"]): r["product"] for r in topics._products(rows).to_pylist()}
        want = {(a * 5, b * 5): (matrix[:, a] @ matrix[:, b]) for a in range(9) for b in range(a + 1, 9) if matrix[:, a] @ matrix[:, b]}
        assert found == pytest.approx(want)


def _prose(spark, n=80):
    """Common words, words of a topic and words found once."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        words = [
            f"common{rng.integers(4)}" if x < 0.5 else f"topic{i % 4}x{rng.integers(6)}" if x < 0.7 else f"rare{rng.integers(3000)}"
            for x in rng.random(30)
        ]
        rows.append((i, i % 4 - 1, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id bigint, topic_id int, text string").repartition(4)


def test_runs_ruled_out_change_no_mix(spark, monkeypatch):
    docs = _prose(spark)
    weights = topics.c_tf_idf(topics.term_counts(docs)).localCheckpoint()
    # the model does not know all words of the documents
    part = weights.filter("term <> 'common1' and not term like 'rare1%'").localCheckpoint()
    for known in (weights, part):
        mixes = []
        for most in (1 << 20, 40, 0):
            monkeypatch.setattr(topics, "FREQUENT", most)
            mix = topics.approximate_distribution(docs, known)
            mixes.append({(r["doc_id"], r["topic_id"]): r["probability"] for r in mix.collect()})
        assert len(mixes[0]) > 40
        assert mixes[1] == pytest.approx(mixes[0]) and mixes[2] == pytest.approx(mixes[0])
    assert topics.approximate_distribution(docs, weights.filter("topic_id = -1")).count() == 0


def test_few_terms_of_the_mix_are_looked_up(spark, monkeypatch):
    lone = spark.range(300).selectExpr("id + 1000 AS doc_id", "-1 AS topic_id", "concat_ws(' ', transform(sequence(1, 30), x -> concat('lone', id * 30 + x))) AS text")
    docs = _prose(spark).unionByName(lone)
    weights = topics.c_tf_idf(topics.term_counts(docs)).localCheckpoint()
    asked, deal = [], parcels.deal

    def kept(rows, keys, parts):
        asked.append(rows.localCheckpoint())
        return deal(asked[-1], keys, parts)

    monkeypatch.setattr(parcels, "deal", kept)
    mix = topics.approximate_distribution(docs, weights)
    # before, every term of a block was
    assert 0 < asked[0].count() < weights.select("term").distinct().count() / 2
    assert not _shuffled(mix)


def test_terms_of_closest_documents_travel_in_parcels(spark):
    docs = _prose(spark)
    weights = topics.c_tf_idf(topics.term_counts(docs)).localCheckpoint()
    close = topics.representative_documents(docs, weights, 2)
    assert not _shuffled(close)
    assert close.count() == 2 * 4
    assert topics.representative_documents(docs, weights.filter("topic_id = 2"), 2).count() == 2


def test_labels_leave_the_texts_where_they_are(spark):
    docs = _prose(spark).localCheckpoint()
    weights = topics.c_tf_idf(topics.term_counts(docs)).localCheckpoint()
    labels = topics.label_documents(docs, weights, "[DOCUMENTS][KEYWORDS]", 2, 3)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x]
    assert labels.count() == 4
