import numpy as np
from pyspark.sql import functions as F

from trendloom.operators import neighbours
from trendloom.plans import subsets


def test_vectors_do_not_grow_with_the_number_of_subsets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = [(i, i * 7 % 40, rng.normal(size=6).tolist()) for i in range(400)]
    members = spark.createDataFrame(points, "id bigint, place bigint, embedding array<double>")
    widths = []
    search = neighbours.knn_cosine
    monkeypatch.setattr(
        neighbours, "knn_cosine",
        lambda wide, *rest, **more: widths.append(len(wide.first()["embedding"])) or search(wide, *rest, **more),
    )
    near = {(r["id"], r["rank"]): r["neighbour"] for r in subsets.knn_within(members, 3).collect()}
    assert not widths
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in points}
    for i, place, _ in points:
        others = sorted((round(1 - unit[i] @ unit[j], 9), j) for j, p, _ in points if p == place and j != i)
        assert [near[i, r] for r in (1, 2, 3)] == [j for _, j in others[:3]]
    # some subsets too large for a task
    more = members.withColumn("place", F.when(F.col("place") < 10, F.col("place")).otherwise(F.lit(10) + F.col("place") % 2))
    whole = {tuple(r) for r in subsets.knn_within(more, 3).select("id", "neighbour", "rank").collect()}
    monkeypatch.setattr(neighbours, "WHOLE", 50)
    assert {tuple(r) for r in subsets.knn_within(more, 3).select("id", "neighbour", "rank").collect()} == whole
    assert widths == [8]
