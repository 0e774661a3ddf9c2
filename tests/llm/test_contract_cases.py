"""Cases that contracts name: wide vectors, ids with several texts, plain FTRL, bitmaps that are full."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import bitslices, decontamination, near_duplicates, toxicity


def test_top_k_keeps_every_finite_vector(spark, monkeypatch):
    monkeypatch.setattr(bitslices, "BLOCK", 8)
    monkeypatch.setattr(bitslices, "QUERIES", 2)
    monkeypatch.setattr(bitslices, "TOGETHER", 1)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 12)).tolist(), 1.0) for i in range(60)]
    rows += [(0, rows[0][1], 1.0), (20, [300_000.0, 1.0, 0.0, 2.0], 1.0), (70, [1e200, -1e200, 0.0, 1.0], 1.0), (71, [-1e200] * 4, 1.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(3)
    got = bitslices.top_k(bitslices.quantised(frame), F.col("id") % 20 == 0, 70).collect()

    def whole(v):
        pairs = [x.as_integer_ratio() for x in v]
        return [64 * a // b for a, b in pairs]

    ints = [(i, whole(v)) for i, v, _ in rows]
    want = []
    for at, (q, v) in enumerate(ints):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(ints) if n != at)
            for rank, (s, i) in enumerate(scores, 1):
                want.append((q, rank, i, -s if -(1 << 63) <= -s < 1 << 63 else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_ids_with_several_texts_lose_no_link(spark):
    base_a = [f"a{i}" for i in range(200)]
    base_b = [f"b{i}" for i in range(200)]
    near = lambda words: " ".join([*words[:199], "end"])
    rows = [(1, " ".join(base_a)), (1, " ".join(base_b)), (2, near(base_b)), (3, near(base_a)), (4, "alone here"), (1, " ".join(base_a))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_more_pivots_than_one_row_holds(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HEADS", 2)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(50):
        words = [f"w{i}" for i in range(60)]
        for at in rng.integers(0, 60, int(rng.integers(0, 6))):
            words[at] = f"e{rng.integers(0, 5)}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for _ in sets:
        for a, s in sets.items():
            for b, t in sets.items():
                if 100 * len(s & t) >= 85 * len(s | t):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == label


def plain_ftrl(rows, labels):
    """The rule as in its description, coordinate by coordinate."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        zero = 0 if i == -1 else toxicity.L1
        if abs(z[i]) <= zero:
            return 0.0
        return (math.copysign(zero, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for found, label in zip(rows, labels):
            used = [*found.tolist(), -1]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in used:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}


def test_weights_equal_plain_ftrl():
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 15, 12)) for _ in range(150)]
    labels = [int("w3" in t.split() and "w7" in t.split()) for t in texts]
    rows = [toxicity.features(t) for t in texts]
    at, weights = toxicity.learn(rows, labels)
    want = plain_ftrl(rows, labels)
    got = dict(zip(at.tolist(), weights.tolist()))
    assert len(want) > 10 and set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_labels_that_repeat_count_once(spark):
    rows = [(i, f"text {i} " + ("bad words" if i % 3 == 0 else "fine day")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    once, often = (
        toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect() for x in (labels, labels + labels[:40] * 5)
    )
    assert sorted(once) == sorted(often) and once
    scored = toxicity.score(docs.withColumn("score", F.lit("x")), toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert scored.columns == ["doc_id", "text", "score", "n_features"]


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_decontamination_with_full_bitmaps(spark, bits):
    rng = np.random.default_rng(11)
    item = [" ".join(f"w{i}" for i in rng.integers(0, 9, n)) for n in (30, 14, 13, 5, 3, 3, 1)]
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 9, 60)) for _ in range(12)]
    texts += [f"{texts[0]} {item[0]}; {item[0]}", f"{item[1]}\n", item[3], f"x {item[2].upper()}-y", "w1 w2", "", None, item[0]]
    docs = spark.createDataFrame([(i % 19, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(item)], "item_id long, text string")

    def words(t):
        return [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in t or "").split()]

    want = []
    for i, t in enumerate(texts):
        w, hit, items = words(t), set(), set()
        for name, x in enumerate(item):
            v = words(x)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k + 1, k + n + 1))
                    items.add(str(name))
        want.append((i % 19, len(w), sorted(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r["doc"], r["n_words"], sorted(r["hit"]), r["items"], r["contaminated"]) for r in decontamination.judge(docs, bench, most_bits=bits).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert decontamination.clean(docs, bench).count() == sum(not x[4] for x in want)
    assert decontamination.contamination(docs, bench).columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items", "hit", "contaminated"]
