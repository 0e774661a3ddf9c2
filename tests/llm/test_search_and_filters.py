"""Search, near-duplicates, repeated windows, decontamination and toxicity against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from trendloom.llm import bitslices, decontamination, near_duplicates, substring_duplicates, toxicity
from trendloom.llm.components import components


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitslices, "BLOCK", 50)
    monkeypatch.setattr(bitslices, "QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 8).round(1).tolist()) for i in range(200)]
    odd = [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (203, [float("inf")]), (204, []), (205, [0.5]), (None, [1.0])]
    frame = spark.createDataFrame([*rows, *odd, rows[3]], "vec_id long, embedding array<float>")
    got = bitslices.top_k(bitslices.quantised(frame), bitslices.F.col("id") % 20 == 0, 5)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    whole = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in [*rows, (205, [0.5])]}
    whole = {i: np.pad(v, (0, 8 - len(v))) for i, v in whole.items()} | {204: np.zeros(8, int)}
    want = {}
    for q in range(0, 200, 20):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(scores[:5], 1)}
    assert found == want
    assert bitslices.top_k(bitslices.quantised(frame.filter("false")), bitslices.F.col("id") == 0).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    return out


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(r[0], r[1]) for r in docs.filter("doc_id is not null").select("doc_id", "text").collect()]
    for k in range(60):  # copies at many distances, around the threshold, too
        text = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 8))):
            text[at] = f"e{rng.integers(0, 9)}"
        rows.append((100 + k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(frame).collect()}
    sets = sets_of(rows)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_of_odd_rows(docs, no_docs):
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert by[4]["n_shingles"] == 0 and by[4]["kept"] and by[9]["kept"]
    assert not by[2]["kept"] and by[6]["n_shingles"] == 1
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40)], "a long, b long")
    nodes = spark.range(60)
    got = {r["id"]: r["component"] for r in components(nodes, links).collect()}
    assert got == {i: 0 if i <= 30 else 40 if i == 50 else i for i in range(60)}


@pytest.mark.parametrize("local", [20_000, 2])
def test_repeated_windows_equal_brute_force(spark, docs, no_docs, local):
    extra = [(20, "ab" * 300), (21, "q" + "é" * 150 + "z"), (22, "é" * 150)]
    frame = docs.unionByName(spark.createDataFrame([(i, t, "", 0) for i, t in extra], docs.schema))
    rows = [(r[0], (r[1] or "").encode()) for r in frame.select("doc_id", "text").collect()]
    count = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = Counter()
    for i, t in rows:
        hit = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, h in zip(t, hit) if not h)
        want[i, len(t), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()] += 1
    found = substring_duplicates.remove_repeats(frame, local=local)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found.collect())
    assert got == want
    assert substring_duplicates.remove_repeats(no_docs).count() == 0


def test_decontamination(spark, docs, no_docs):
    item = " ".join(f"word{i} and{i % 7}" for i in range(4, 20))
    bench = spark.createDataFrame([(1, item), (2, "Hi"), (3, None), (4, "..."), (None, "no id"), (5, "absent words")], "item_id long, text string")
    by = {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.contamination(docs, bench).collect()}
    assert (1, 32, 1, True) in by and (6, 1, 1, True) in by and (4, 0, 0, False) in by
    assert (None, 2, 0, True) in by and (7, 32, 1, False) in by
    assert decontamination.contamination(docs, bench).count() == docs.count()
    assert decontamination.contamination(no_docs, bench).count() == 0
    assert decontamination.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0
    cut = decontamination.remove_spans(decontamination.contamination(docs.filter("doc_id = 6"), bench)).first()
    assert cut["kept_text"] == ""


def test_toxicity_learns_and_leaves_the_held_out_rows_alone(spark):
    rows = [(i, f"plain text number {i} " + ("you utter moron" if i % 5 == 0 else "nice day")) for i in range(800)]
    frame = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.score(frame, toxicity.train(frame, labels)).collect()
    assert len(scored) == 802 and all(0 <= r["score"] <= 1 for r in scored)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in scored if r["doc_id"] is not None and r["doc_id"] < 800)
    none = toxicity.score(frame, toxicity.train(frame, labels.filter("false")))
    assert {r["score"] for r in none.collect()} == {0.5}
