import numpy as np
import pytest

from trendloom.operators import clusters, topics
from trendloom.schemas import OUTLIER


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def kruskal(edges, nodes):
    parent = {n: n for n in nodes}
    kept = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        ra, rb = find(parent, a), find(parent, b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b, w))
    return kept, {n: find(parent, n) for n in nodes}


def validity(labels, forest):
    sizes = {c: sum(x == c for x in labels.values()) for c in set(labels.values()) - {OUTLIER}}
    inner, outer = {c: 0.0 for c in sizes}, {}
    for a, b, w in forest:
        x, y = labels[a], labels[b]
        if OUTLIER in (x, y):
            continue
        if x == y:
            inner[x] = max(inner[x], w)
        else:
            for c in (x, y):
                outer[c] = min(outer.get(c, np.inf), w)
    heaviest = max(w for *_, w in forest)
    mixed = [w for a, b, w in forest if (labels[a] == OUTLIER) != (labels[b] == OUTLIER)]
    far = 2 * (heaviest if len(sizes) > 1 else min(mixed, default=heaviest))
    parts = [(outer.get(c, far) - inner[c]) / max(outer.get(c, far), inner[c]) * n for c, n in sizes.items()]
    return sum(parts) / len(labels)


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(11)
    spots = np.concatenate([rng.normal(c, 0.4, size=(14, 2)) for c in ((0, 0), (6, 0), (0, 7))] + [rng.uniform(-9, 12, size=(8, 2))])
    gaps = np.round(np.linalg.norm(spots[:, None] - spots[None], axis=2), 6)
    k, rows = 5, []
    for i in range(len(spots)):
        near = sorted((gaps[i, j], j) for j in range(len(spots)) if j != i)[:k]
        rows += [(i, j, float(d), n + 1) for n, (d, j) in enumerate(near)]
    return rows, spark.createDataFrame(rows, "id long, neighbour long, distance double, rank int")


def reach(rows, samples):
    core = {}
    for i, _, d, rank in rows:
        if rank <= samples:
            core[i] = max(core.get(i, 0), d)
    return {(min(i, j), max(i, j)): max(d, core[i], core[j]) for i, j, d, _ in rows}


def brute(rows, samples, size, eps):
    edges = [(a, b, w) for (a, b), w in reach(rows, samples).items()]
    nodes = {r[0] for r in rows}
    _, component = kruskal([e for e in edges if e[2] <= eps], nodes)
    sizes = {c: sum(x == c for x in component.values()) for c in component.values()}
    labels = {n: c if sizes[c] >= size else OUTLIER for n, c in component.items()}
    return labels, kruskal(edges, nodes)[0]


def test_sweep_scores_and_best_setting(graph):
    rows, near = graph
    scores, best = clusters.cluster_sweep(near, [2, 4], [3, 12], 2, 0.9)
    found = {(r.min_samples, r.min_cluster_size): (r.clusters, r.score) for r in scores.collect()}
    want = {}
    for samples in (2, 4):
        for size in (3, 12):
            labels, forest = brute(rows, samples, size, 0.9)
            want[samples, size] = (len(set(labels.values()) - {OUTLIER}), validity(labels, forest), labels)
    for setting, (count, score, _) in want.items():
        assert found[setting][0] == count
        assert found[setting][1] == pytest.approx(score)
    top = max((s for s in want if want[s][0] >= 2), key=lambda s: want[s][1])
    assert {r.id: r.cluster for r in best.collect()} == want[top][2]
    with pytest.raises(ValueError):
        clusters.cluster_sweep(near, [2], [3], 99, 0.9)


def test_forest_and_one_run(graph):
    rows, near = graph
    from trendloom.operators.neighbours import core_distance

    core = core_distance(near, 3)
    forest = clusters.spanning_forest(clusters.mutual_reachability(near, core))
    labels, want = brute(rows, 3, 4, 0.9)
    assert {tuple(r) for r in forest.collect()} == set(want)
    found = clusters.density_clusters(near, 3, 4, 0.9)
    assert {r.id: r.cluster for r in found.collect()} == labels
    row = clusters.validity_score(found, forest).first()
    assert row.score == pytest.approx(validity(labels, want))
    strength = {r.id: r.probability for r in clusters.membership_strength(found, core).collect()}
    assert all(0 <= p <= 1 for p in strength.values())
    assert all((strength[i] == 0) == (c == OUTLIER) for i, c in labels.items())


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    nodes = spark.range(202)
    found = clusters.connected_components(nodes, edges).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in found} == {(0, 201), (201, 1)}


def test_varied_keywords(spark):
    rows = [(0, "a", 9.0), (0, "b", 8.9), (0, "c", 3.0), (1, "a", 5.0), (1, "b", 5.0), (1, "d", 1.0)]
    weights = spark.createDataFrame(rows, "topic_id int, term string, weight double")
    # relevance: c 1, a .874, b .872; likeness to c equals relevance, so a follows while
    # 1 - diversity exceeds diversity, and b, the less alike, beyond
    for diversity, second in ((0.1, "a"), (0.6, "b")):
        found = topics.mmr_keywords(weights, 2, diversity).filter("topic_id = 0").collect()
        assert {r["rank"]: r.term for r in found} == {1: "c", 2: second}


def test_mix_adds_up_and_short_texts(spark):
    docs = spark.createDataFrame(
        [(1, 0, "red shoe red boots"), (2, 1, "green tree"), (3, -1, "shoe"), (4, -1, ""), (5, -1, "unknown words only")],
        "doc_id long, topic_id int, text string",
    )
    weights = topics.c_tf_idf(topics.term_counts(docs))
    mix = topics.approximate_distribution(docs, weights).collect()
    totals = {}
    for r in mix:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.probability
    assert set(totals) == {1, 2, 3} and all(t == pytest.approx(1) for t in totals.values())
    moved = topics.reduce_outliers(docs, topics.approximate_distribution(docs, weights), 0.5)
    assert {r.doc_id: r.topic_id for r in moved.collect()} == {1: 0, 2: 1, 3: 0, 4: -1, 5: -1}


def test_seeds_reach_the_end_of_a_chain(spark):
    links = [(i, j) for i in range(12) for j in (i - 1, i + 1) if 0 <= j < 12]
    neighbours = spark.createDataFrame(links, "id long, neighbour long")
    seeds = spark.createDataFrame([(0, 3)], "id long, topic_id long")
    rows = clusters.seeded_clusters(neighbours, seeds).collect()
    assert {r["id"]: r["topic_id"] for r in rows} == dict.fromkeys(range(12), 3)
