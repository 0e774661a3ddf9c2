"""The stages of the corpus pipeline."""

import corpus_pipeline


def test_near_copies_by_five_words_at_80_percent(spark):
    words = [f"w{i}" for i in range(100)]
    longer = [*words, *(f"more{i}" for i in range(20))]  # 96 of 116 shingles of five words: 0.828
    other = [f"v{i}" for i in range(100)]
    edited = [*other]
    for at in (20, 40, 60, 80):  # 76 of 116 shingles of five words: 0.655
        edited[at] = "edit"
    rows = [(1, words), (2, longer), (3, other), (4, edited)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert {r["doc_id"] for r in left.collect()} == {1, 3, 4}
