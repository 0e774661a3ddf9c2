"""SimHash near-duplicates by a hierarchical index in Gray order.

A document's fingerprint has a bit set where more than half of the hashes of its word shingles,
repeats included, have it. Equal fingerprints are one entry of the index. Entries are sorted by
their rank in the Gray code, in which neighbours differ in few bits, and every ``FANOUT`` in a row
form a node. A node holds the pattern its entries share, as a mask of bits and their values; its
entries keep only the bits beyond the mask. Nodes in a row form nodes of the next level in the same
way, up to one root, so that what whole groups have in common is stored once.

The index is joined with itself from the root down. A pair of nodes carries the differences found in
bits that both share so far; a pair of their children adds those in the bits that the children share
beyond that. A pair with more than ``distance`` differences is pruned with all that lies below
it. What arrives at the bottom are the pairs of fingerprints that link. A pair of blocks hands on
links that connect what it connects, not each of its pairs, so that large groups of near copies
stay small. A node has at most ``FANOUT`` entries, and pairs of nodes are rows of their own, so no
group is brought into one task; the levels grow with the logarithm of the documents.

Words are runs of characters other than ASCII white space, with A-Z in lower case; a text of fewer
words than a shingle is one shingle. Null texts and texts without words have fingerprint zero and
are linked like any other. Repeated rows are copies of each other; the texts of one id are tied
together. Rows with a null id have a fingerprint, but no component, and link nothing. Long texts
are read in slices. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import text_of, tidy
from trendloom.llm.components import components
from trendloom.operators.ranking import with_position
from trendloom.session import settle

FANOUT = 64
DISTANCE = 2
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = b" \t\n\x0b\x0c\r"
SLICE = 1 << 20  # bytes of a text looked at together


def word_slices(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, each time after the last ``overlap`` words before."""
    at, before = 0, []
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in SPACE:
            end += 1
        words = before + data[at:end].split()
        yield words
        at, before = end, words[max(0, len(words) - overlap) :] if overlap else []


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    ones, count = np.zeros(64, np.int64), 0
    for words in word_slices(text.translate(LOWER), shingle - 1):
        if len(words) < shingle:
            if count or len(text) > SLICE:
                continue  # nothing new, or judged below
            hashes = [xxh64_intdigest(b" ".join(words), SEED)] if words else []
        else:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            last = len(words) - shingle + 1
            places = zip(starts[:last].tolist(), ends[shingle - 1 :].tolist())
            hashes = [xxh64_intdigest(whole[a:b], SEED) for a, b in places]
        found = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        for part in range(0, len(found), 8192):
            ones += np.unpackbits(found[part : part + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
    if not count and len(text) > SLICE:  # a few words in a very long text
        words = text.translate(LOWER).split()
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a bigint) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), text_of(text).cast("binary").alias("text"))

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("id"), pa.array(signed)], names=["id", "fp"])

    return rows.mapInArrow(tidy(sign), f"id {kind}, fp bigint")


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit word in the Gray code, as a bigint in ascending order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order


def index_levels(entries: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The nodes of each level, the lowest first, for distinct ``fp``.

    ``node``, ``mask`` and ``value`` (the shared pattern), and in Gray order the ``keys`` of the
    entries (fingerprints at the lowest level, nodes above) with their remaining ``masks`` and
    ``values``.
    """
    placed = with_position(entries.select("fp"), [gray_rank(F.col("fp"))])
    rows = placed.select(
        F.col("position"), F.col("fp").alias("key"), F.lit(-1).cast("long").alias("mask"), F.col("fp").alias("value")
    )
    levels = []
    while True:
        grouped = rows.groupBy(F.expr(f"position div {fanout}").alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("position", "key", "mask", "value"))).alias("_entries"),
            F.bit_and("mask").alias("_known"),
            F.bit_and("value").alias("_all"),
            F.bit_or("value").alias("_any"),
        )
        mask = F.col("_known").bitwiseAND(F.bitwise_not(F.col("_all").bitwiseXOR(F.col("_any"))))
        shared = grouped.withColumn("mask", mask).withColumn("value", F.col("_all").bitwiseAND(mask))
        beyond = F.bitwise_not("mask")
        level = settle(
            shared.select(
                "node",
                "mask",
                "value",
                F.transform("_entries", lambda e: e["key"]).alias("keys"),
                F.transform("_entries", lambda e: e["mask"].bitwiseAND(beyond)).alias("masks"),
                F.transform("_entries", lambda e: e["value"].bitwiseAND(beyond)).alias("values"),
            )
        )
        levels.append(level)
        if level.count() <= 1:
            return levels
        rows = level.select(F.col("node").alias("position"), F.col("node").alias("key"), "mask", "value")


def spanning(first: list[int], second: list[int], same: bool, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all rows and columns which ``near`` connects; ``same``: both sides are the
    same entries."""
    rows, columns = np.nonzero(near)
    offset = 0 if same else len(first)
    leader = list(range(offset + len(second)))
    out = []
    for i, j in zip(rows.tolist(), columns.tolist()):
        a, b = i, j + offset
        while leader[a] != a:
            leader[a] = a = leader[leader[a]]
        while leader[b] != b:
            leader[b] = b = leader[leader[b]]
        if a != b:
            leader[b] = a
            out.append((first[i], second[j]))
    return out


def descend(pairs: DataFrame, level: DataFrame, lowest: bool, distance: int) -> DataFrame:
    """Pairs of nodes, one level further down: pairs of children with up to ``distance``
    differences, or links ``a``, ``b`` from the lowest level."""
    sides = []
    for x in "ab":
        held = [F.col(c).alias(f"{c}_{x}") for c in ("keys", "masks", "values")]
        sides.append(level.select(F.col("node").alias(x), *held))
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    patterns = ["mask_a", "value_a", "mask_b", "value_b"]
    names = ["a", "b"] if lowest else ["a", "b", "seen", *patterns]

    def expand(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            columns = np.concatenate(found, axis=1) if found else np.empty((len(names), 0), np.int64)
            return pa.record_batch([pa.array(c) for c in columns], names=names)

        def unsigned(column, row: int) -> np.ndarray:
            return column[row].values.to_numpy().view(np.uint64)

        for batch in batches:
            held = {c: batch.column(c) for c in batch.schema.names}
            plain = {c: held[c].to_numpy() for c in ("a", "b", "seen", *patterns)}
            path = {c: plain[c].view(np.uint64) for c in patterns}
            found, size = [], 0
            for row in range(batch.num_rows):
                ma, va, mb, vb = (path[c][row] for c in patterns)
                masks_a = unsigned(held["masks_a"], row) | ma
                masks_b = unsigned(held["masks_b"], row) | mb
                values_a = unsigned(held["values_a"], row) | va
                values_b = unsigned(held["values_b"], row) | vb
                # bits that both children share and their parents did not
                new = masks_a[:, None] & masks_b[None, :] & ~(ma & mb)
                differing = np.bitwise_count((values_a[:, None] ^ values_b[None, :]) & new)
                seen = differing.astype(np.int64) + plain["seen"][row]
                near = seen <= distance
                same = plain["a"][row] == plain["b"][row]
                if same:
                    near &= np.tri(len(masks_a), k=-1 if lowest else 0, dtype=bool).T
                if not near.any():
                    continue
                keys_a, keys_b = (held[c][row].values.to_numpy() for c in ("keys_a", "keys_b"))
                if lowest:
                    links = spanning(keys_a.tolist(), keys_b.tolist(), same, near)
                    found.append(np.array(links, np.int64).T)
                else:
                    i, j = np.nonzero(near)
                    kept = [masks_a[i], values_a[i], masks_b[j], values_b[j]]
                    found.append(np.stack([keys_a[i], keys_b[j], seen[i, j], *(k.view(np.int64) for k in kept)]))
                size += found[-1].shape[1]
                if size > 50_000:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

    return met.mapInArrow(tidy(expand), ", ".join(f"{n} bigint" for n in names))


def fingerprint_links(entries: DataFrame, distance: int = DISTANCE, fanout: int = FANOUT) -> DataFrame:
    """``a``, ``b``: links that connect all fingerprints (``fp``, distinct) that chains of up to
    ``distance`` differing bits connect."""
    levels = index_levels(entries, fanout)
    pattern = [F.col(c).alias(f"{c}_{x}") for x in "ab" for c in ("mask", "value")]
    pairs = levels[-1].select(
        F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("seen"), *pattern
    )
    for depth in reversed(range(len(levels))):
        pairs = settle(descend(pairs, levels[depth], depth == 0, distance))
    return pairs


def simhash_duplicates(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the key, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest key
    reachable over links)."""
    signed = settle(fingerprints(docs, shingle, key, text))
    known = signed.filter(F.col("id").isNotNull())
    entries = settle(known.groupBy("fp").agg(F.min("id").alias("least")))
    links = fingerprint_links(entries, distance)
    # an id with several texts ties their fingerprints together
    ties = (
        known.groupBy("id")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("_last"))
        .filter("a < _last")
        .join(known.distinct(), "id")
        .select("a", F.col("fp").alias("b"))
    )
    groups = components(entries.select(F.col("fp").alias("id")), links.unionByName(ties))
    placed = entries.join(groups.withColumnRenamed("id", "fp"), "fp")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # grouped first: a component may hold many fingerprints, a fingerprint many documents
    of_fp = settle(placed.join(least, "component").select("fp", "component_id"))
    return signed.join(of_fp, "fp", "left").select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
