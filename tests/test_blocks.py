import numpy as np
import pytest

from trendloom.operators import topics

WORDS = [f"w{i}" for i in range(30)]


def _docs(spark, n=60):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), " ".join(rng.choice(WORDS[i % 3 * 8 : i % 3 * 8 + 12], 40))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, topic_id int, text string").repartition(4)


def test_terms_are_looked_up_once_per_block(spark):
    docs = _docs(spark)
    blocks, names = topics._in_blocks(docs)
    terms = topics._block_terms(blocks, names, 4, 1, 1, [])
    assert terms.count() == len({w for r in docs.collect() for w in r["text"].split()})


def test_topic_mix_and_closest_documents_do_not_depend_on_blocks(spark, monkeypatch):
    docs = _docs(spark)
    weights = topics.c_tf_idf(topics.term_counts(docs)).localCheckpoint()

    def results():
        mix = topics.approximate_distribution(docs, weights)
        close = topics.representative_documents(docs, weights, 4)
        return {(r[0], r[1]): r[2] for r in mix.collect()}, sorted(map(tuple, close.collect()))

    mix, close = results()
    assert len(close) == 12 and len({d for d, _ in mix}) == 60
    monkeypatch.setattr(topics, "BLOCK_CHARS", 300)
    monkeypatch.setattr(topics, "LEAST_CHARS", 100)
    blocks, names = topics._in_blocks(docs, ["topic_id"])
    assert blocks.select(*names).distinct().count() > 15
    cut, again = results()
    assert cut == pytest.approx(mix) and again == close
