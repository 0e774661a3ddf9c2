"""Collocations, vector codes and SimHash against brute force, and their SQL on the smallest tables."""

import hashlib
import re
from collections import Counter
from fractions import Fraction
from itertools import product
from math import floor

import numpy as np
import pytest
import xxhash

from tests.oracle import connect, table
from trendloom.llm import phrases, queries, simhash, vector_codes
from trendloom.llm.sql import SQL

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_vector_codes"])
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    cursor = connect(SF).execute(SQL[name])
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())


# collocations


def collocations(rows, least, top, percent=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    held = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in held.items():
        longer = [
            n for (other, v), n in held.items()
            if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        ]
        if any(100 * n >= percent * a for n in longer):
            continue
        parts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(parts))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, x, y, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1)
    }


def phrase_rows():
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(12)] + ["Ä", "É\x1cé", "naïve"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", ",", " ; ", "\x0b"]
    rows = []
    for n in range(60):
        text = "".join(f"{names[int(rng.exponential(3)) % len(names)]}{marks[rng.integers(len(marks))]}" for _ in range(40))
        rows.append((["en", "De", None, "und"][n % 4], f"New York Stock Exchange {text}" if n % 3 else text.upper()))
    return [*rows, rows[0], ("en", None), ("en", ""), ("xx", "..."), (None, "a"), ("en", "same words " * 3000)]


def test_collocations_equal_brute_force(spark):
    rows = phrase_rows()
    frame = spark.createDataFrame([(n, *r, 7) for n, r in enumerate(rows)], "n long, lang string, text string, w1 int")
    got = phrases.collocations(frame.repartition(3), least=5, top=25)
    assert {tuple(r) for r in got.collect()} == collocations(rows, 5, 25)
    assert max(Counter(r["lang"] for r in got.collect()).values()) == 25
    assert phrases.collocations(frame.filter("false")).count() == 0


def test_a_full_filter_changes_no_count(spark):
    frame = spark.createDataFrame(phrase_rows(), "lang string, text string")
    full, free = (phrases.phrase_counts(frame, 5, most_bits=bits).collect() for bits in (64, 1 << 20))
    assert sorted(map(str, full)) == sorted(map(str, free))


@pytest.mark.parametrize("size", [1, 30, 1000])
def test_slices_hold_every_window_once(size):
    texts = [(r[1] or "").encode() for r in phrase_rows()]

    def windows(most):
        found = Counter()
        for data, upto in phrases.slices(texts, most):
            words, ids, counted = phrases.numbered(data, upto)
            for i in np.flatnonzero(ids[:counted]):
                window = ids[i : i + 4].tolist()
                window = window[: window.index(0)] if 0 in window else window
                found[tuple(words[x] for x in window)] += 1
        return found

    assert windows(size) == windows(1 << 30)


def test_scores_pass_64_bits(spark):
    a = 1 << 60
    rows = [("en", 0, [], "", a), *(("en", 1, [w], w, 3 * a // 2) for w in "xy"), ("en", 2, ["x", "y"], "x y", a)]
    counts = spark.createDataFrame(rows, "lang string, size int, words array<string>, phrase string, a long")
    assert [r["score"] for r in phrases.scored(counts).collect()] == [2_000_000 * a // (3 * a // 2 * 2)]


# vector codes


def vector_codes_of(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[floor(4096 * Fraction(x)) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for e, found in groups.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for (i, _, lab), v in zip(kept, cut):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab, digest))
    most = (1 << 63) - 1
    sums = Counter()
    for _, _, error, lab, _ in out:
        sums[lab] += error if error <= most else 1 << 100
    return sorted(
        (str(i), c, e if e <= most else None, sums[lab] if sums[lab] <= most else None, d) for i, c, e, lab, d in out
    )


def coded(spark, rows, kind="float"):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, v int")
    return sorted((str(r[0]), *tuple(r)[1:]) for r in vector_codes.compress(frame.repartition(3)).collect())


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-6, 7, 24) / 8).tolist(), [None, 1, 2][i % 3]) for i in range(120)]
    rows += [(3, rows[3][1], 1), (5, rows[7][1], 1), (None, rows[9][1], None), (-1, [0.25] * 11, 2)]
    odd = [(-2, None, 1), (-3, [None] * 24, 1), (-4, [float("nan")] * 24, 1), (-5, [float("-inf")] * 24, 5)]
    assert coded(spark, rows + odd) == vector_codes_of(rows)
    assert coded(spark, rows[:5]) == vector_codes_of(rows[:5])  # fewer vectors than entries
    empty = spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty).count() == 0


def test_codes_of_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 10.0 ** rng.integers(0, 7), 16)).tolist(), i % 2) for i in range(40)]
    assert coded(spark, rows, "double") == vector_codes_of(rows)
    rows += [(50, [1e30] * 16, 3), (51, [-1e300, *[1e9] * 15], 4)]
    assert coded(spark, rows, "double") == vector_codes_of(rows)


def test_transform_grows_distances_by_its_size():
    for width in (1, 3, 8, 13):
        rng = np.random.default_rng(width)
        parts, entries = rng.integers(-99, 99, (30, width)), rng.integers(-99, 99, (5, width))
        codes, far = vector_codes.nearest(parts, entries)
        every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (far == every.min(axis=1)).all() and (codes == every.argmin(axis=1)).all()
    matrix = vector_codes.transformed(np.eye(16, dtype=np.int64)).T
    assert [int((np.diff(row) != 0).sum()) for row in matrix] == list(range(16))


# SimHash


def fingerprint_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    found = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash_equals_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    for k in range(150):  # copies around the threshold
        text = list(base)
        for at in rng.integers(0, 400, int(rng.integers(0, 10))):
            text[at] = f"E{rng.integers(0, 9)}"
        rows.append((100 + k, " \t".join(text)))
    rows += [(100, "another text of one id"), (None, rows[-1][1]), (99, "another text of one id")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fingerprint string")
    got = sorted(map(str, simhash.simhash_duplicates(frame).collect()))
    fps = [(i, fingerprint_of(t)) for i, t in rows]
    known = [(i, f) for i, f in fps if i is not None]
    links = [(a, b) for (a, f), (b, g) in product(known, known) if (f ^ g).bit_count() <= 2]
    label = groups(links, [i for i, _ in known])
    row = spark.createDataFrame([(1, "", 1)], "doc_id long, fingerprint string, component_id long").first()
    want = sorted(str(type(row)(**{"doc_id": i, "fingerprint": f"{f:016x}", "component_id": label.get(i)})) for i, f in fps)
    assert got == want and len(set(label.values())) > 5
    assert simhash.simhash_duplicates(frame.filter("false")).count() == 0


def test_index_links_all_chains(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    found = {0, (1 << 64) - 1}
    for centre in centres.tolist():  # dense balls and far members
        for _ in range(60):
            x = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << bit
            found.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(found)]
    entries = spark.createDataFrame([(x,) for x in signed], "fp long")
    mask = (1 << 64) - 1
    near = [(a, b) for a, b in product(signed, signed) if a < b and ((a ^ b) & mask).bit_count() <= 2]
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(entries, fanout=4).collect()]
    assert {tuple(sorted(x)) for x in links} <= set(near)
    assert groups(links, signed) == groups(near, signed)


def test_long_texts_go_by_slices(monkeypatch):
    text = ("ab cd\tEF \n gh12 " * 500).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == want == fingerprint_of(text.decode())
    for short in (b"a" * 50, b"a" * 20 + b" " * 30 + b"b", b" " * 40, b""):
        assert simhash.fingerprint(short) == fingerprint_of(short.decode())
