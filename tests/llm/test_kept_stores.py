"""A store of pieces kept from task to task."""

from public_tokenizers import path
from pyspark.sql import functions as F

from trendloom.llm import packing

VOCABULARY = path("byte_bpe_50k.json")


def test_pieces_are_the_same_with_a_store_that_stays(spark, docs):
    spread = docs.select("doc_id", "text").repartition(6)

    def pieces(**settings):
        found = packing.token_pieces(spread, VOCABULARY, capacity=50, added=True, **settings)
        return sorted(map(str, found.withColumn("ids", F.hex("ids")).collect()))

    expected = pieces()
    assert len(expected) > len(docs.collect())
    for kept in (5, 600_000):
        assert pieces(kept=kept) == expected
