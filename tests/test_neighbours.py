import numpy as np
import pytest

from trendloom.functions import scalars
from trendloom.operators import neighbours
from pyspark.sql import functions as F


def brute(rows, others, k, distance):
    result = set()
    for i, v in rows:
        near = sorted((distance(v, w), j) for j, w in others if others is not rows or j != i)
        result |= {(i, j, d) for d, j in near[:k]}
    return result


def cosine(v, w):
    return round(1 - float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9) + 0.0


def hamming(v, w):
    return float(np.sum((np.array(v) > 0) != (np.array(w) > 0)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    points = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8)]) for i in range(180)]
    # one group of copies holds a third of all rows
    return points + [(1000 + i, points[0][1]) for i in range(90)]


def shaped(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("pivots", [1, 9])
def test_exact_cosine(spark, rows, pivots, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    found = neighbours.knn_cosine(shaped(spark, rows), 4, pivots=pivots).collect()
    assert {(r.id, r.neighbour, r.distance) for r in found} == brute(rows, rows, 4, cosine)


def test_exact_hamming(spark, rows):
    codes = shaped(spark, rows).select("id", scalars.quantize_bits(F.col("embedding")).alias("codes"))
    found = neighbours.knn_hamming(codes, 3, pivots=5).collect()
    assert {(r.id, r.neighbour, r.distance) for r in found} == brute(rows, rows, 3, hamming)


def test_two_sides_and_probes(spark, rows):
    new = [(i, v) for i, v in rows if i % 3 == 0]
    old = [(i + 5000, v) for i, v in rows if i % 3]
    want = brute(new, old, 3, cosine)
    exact = neighbours.knn_cosine(shaped(spark, new), 3, shaped(spark, old), pivots=6).collect()
    assert {(r.id, r.neighbour, r.distance) for r in exact} == want
    some = neighbours.knn_cosine(shaped(spark, new), 3, shaped(spark, old), probes=3, pivots=6).collect()
    hits = {(r.id, r.neighbour, r.distance) for r in some} & want
    assert len(hits) >= 0.9 * len(want)


def test_no_table_per_query_and_cell(spark, monkeypatch):
    """Without structure every cell is in reach; a query is still written once, not once per cell."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(240)]
    written = []

    def settle(frame):
        kept = real(frame)
        written.append(kept.count())
        return kept

    real = neighbours.settle
    monkeypatch.setattr(neighbours, "settle", settle)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    found = neighbours.knn_cosine(shaped(spark, rows), 4, pivots=80).collect()
    assert {(r.id, r.neighbour, r.distance) for r in found} == brute(rows, rows, 4, cosine)
    assert max(written) <= 8 * len(rows)
