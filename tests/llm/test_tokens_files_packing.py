"""Token files, packing and sharding against plain Python."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trendloom.llm import arrow_files, packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids(docs):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    return [
        (r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0])
        for r in docs.select("doc_id", "text").collect()
    ]


def test_files_give_back_every_document_in_order(docs, ids):
    index = arrow_files.write_sequences(docs, PATH, length=64, shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 1
    rows = arrow_files.read_documents(index).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted([i for i, _ in ids], key=lambda i: (i is not None, i or 0))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in rows)
    assert got == Counter((i, np.array(x, "<u4").tobytes()) for i, x in ids)


def test_sequences_have_masks_and_need_no_copy(docs):
    index = arrow_files.write_sequences(docs.filter("doc_id = 1"), PATH, length=64)
    row = index.first()
    file = arrow_files.SequenceFile(row["file"])
    last = file.sequence(row["n_tokens"] // 64)
    assert last["mask"].sum() == row["n_tokens"] % 64
    assert file.sequence(0)["starts"].tolist() == [True] + [False] * 63
    assert not file.sequence(0)["ids"].flags.owndata


def test_no_rows(no_docs):
    index = arrow_files.write_sequences(no_docs, PATH)
    assert arrow_files.read_documents(index).count() == 0
    assert packing.pack(packing.token_pieces(no_docs, PATH)).count() == 0
    assert sharding.shard_documents(no_docs).count() == 0


def test_pieces_and_bins(docs, ids):
    rows = packing.pack(packing.token_pieces(docs, PATH, capacity=100), capacity=100).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    bins: dict = {}
    for r in rows:
        assert 1 <= r["length"] <= 100 and (r["length"] == 100 or r["piece"] == 0 )
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    whole = Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in rows)
    want = Counter()
    for i, x in ids:
        cuts = [0, *range(len(x) % 100 or 100, len(x) + 1, 100)]
        want.update((i, a, np.array(x[a:b], "<u4").tobytes()) for a, b in zip(cuts, cuts[1:]))
    assert whole == want


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(50):
        items = rng.integers(1, 40, 8).tolist()
        room = int(rng.integers(1, 120))
        best = max(s for m in range(256) if (s := sum(x for k, x in enumerate(items) if m >> k & 1)) <= room)
        used = packing.fullest(dict(Counter(items)), room)
        assert sum(x * n for x, n in used.items()) == best
        assert all(n <= items.count(x) for x, n in used.items())


def test_shards_are_even_and_gapless(spark, docs):
    big = docs.unionByName(
        spark.range(100, 3000).selectExpr("id as doc_id", "repeat('ab', cast(id % 50 as int)) as text", "'' as n_words", "1 as length")
    )
    rows = sharding.shard_documents(big).collect()
    assert len(rows) == big.count()
    texts = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in big.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    for shard in range(16):
        places = sorted(r["place"] for r in rows if r["shard"] == shard)
        assert places == list(range(len(places)))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16) ]
    assert max(sizes[:]) >= 45_000  # the long document
    rest = sorted(sizes)[:-1]
    assert max(rest) - min(rest) < 200


def test_an_edit_moves_little(spark):
    first = sharding.first_map(spark, 4, 64)
    sizes = spark.range(64).selectExpr("cast(id as int) as virtual_slot", "cast(100 + id as long) as bytes")
    old = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    new = {r["virtual_slot"]: (r["shard"], r["version"]) for r in sharding.rebalance(first, sizes, 5).collect()}
    moved = [s for s in old if old[s] != new[s][0]]
    assert {v for _, v in new.values()} == {2} and len(moved) < 20
    loads = [sum(100 + s for s in new if new[s][0] == k) for k in range(5)]
    assert max(loads) - min(loads) < 260
