"""Near copies whose texts are found without a shuffle of all texts."""

from trendloom.llm import near_duplicates


def _texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} tail{i // 3}") for i in range(12)]
    rows += [(20, " ".join(f"x{i}" for i in range(40))), (21, None), (None, words), (3, "other text of id three")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_wanted_ids_go_to_the_texts(spark, monkeypatch):
    frame, plans = _texts(spark), []
    real = near_duplicates.shingle_sets

    def watched(texts, *args):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return real(texts, *args)

    monkeypatch.setattr(near_duplicates, "shingle_sets", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = sorted(map(str, near_duplicates.near_duplicates(frame).collect()))
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
        # too many of them: by shuffle, with the same result
        monkeypatch.setattr(near_duplicates, "WANTED", 2)
        monkeypatch.setattr(near_duplicates, "NAMED", 2)
        assert sorted(map(str, near_duplicates.near_duplicates(frame).collect())) == near
        assert "SortMergeJoin" in plans[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
