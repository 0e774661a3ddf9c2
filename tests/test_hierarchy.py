import numpy as np

from trendloom.operators import hierarchy, topics


def greedy_ward(distance):
    """Merge the closest pair again and again; returns the member sets and distances."""
    clusters = {i: ({i}, 1) for i in range(len(distance))}
    d = {(i, j): distance[i, j] for i in range(len(distance)) for j in range(i)}
    get = lambda a, b: d[(max(a, b), min(a, b))]
    fresh, merges = len(distance), []
    while len(clusters) > 1:
        (u, v), best = min(d.items(), key=lambda item: item[1])
        nu, nv = clusters[u][1], clusters[v][1]
        row = {}
        for s, (_, ns) in clusters.items():
            if s not in (u, v):
                square = ((nu + ns) * get(u, s) ** 2 + (nv + ns) * get(v, s) ** 2 - ns * best**2) / (nu + nv + ns)
                row[s] = square**0.5
        members = clusters[u][0] | clusters[v][0]
        del clusters[u], clusters[v]
        d = {k: x for k, x in d.items() if u not in k and v not in k}
        d.update({(fresh, s): x for s, x in row.items()})
        clusters[fresh] = (members, nu + nv)
        merges.append((frozenset(members), best))
        fresh += 1
    return merges


def test_tree_equals_greedy_merging(spark):
    rng = np.random.default_rng(7)
    vectors = np.abs(rng.normal(size=(12, 5)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = vectors @ vectors.T
    pairs = [(i, j, float(cosine[i, j])) for i in range(12) for j in range(i + 1, 12)]
    similarity = spark.createDataFrame(pairs, "topic_a long, topic_b long, similarity double")
    ids = spark.createDataFrame([(i,) for i in range(-1, 12)], "topic_id long")
    rows = hierarchy.topic_hierarchy(ids, similarity).orderBy("parent_id").collect()
    want = greedy_ward(1 - cosine)
    assert [r.parent_id for r in rows] == list(range(12, 23))
    assert [frozenset(r.topics) for r in rows] == [m for m, _ in want]
    assert np.allclose([r.distance for r in rows], [x for _, x in want])

    # the largest merges below a distance are disjoint and hold every smaller one
    limit = sorted(x for _, x in want)[6] + 1e-9
    kept = [frozenset(r.topics) for r in topics.maximal_merges(
        hierarchy.topic_hierarchy(ids, similarity), limit).collect()]
    below = [m for m, x in want if x < limit]
    assert set(kept) == {m for m in below if not any(m < other for other in below)}
