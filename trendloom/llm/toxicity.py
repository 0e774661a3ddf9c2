"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo ``2**BITS``, of its words, its pairs of
neighbouring words and its pairs of words with one or two words between them. The model is learnt
row by row with the follow-the-regularised-leader rule: a learning rate per coordinate, which falls
as that coordinate's gradients add up, and an L1 term that leaves most weights exactly zero; the bias,
which every row has, is free of it. What is left, features and weights, is small (at most one weight per coordinate) and travels with the
tasks that score.

Learning takes at most about ``SAMPLE`` labels, chosen by a hash of their id: each labelled id is
in or out whatever the other rows are, at a rate of ``SAMPLE`` by the number of distinct pairs of
id and label. Equal labels of an id count once, with the least of its texts. One task learns from them in the order of that hash, over several passes. Scoring
reads every whole text.

Rows without a label teach nothing; null and empty texts have no features and score by the bias
alone; without labels of both kinds the model has no rows and the score is 0.5 for all. Texts of any
length are read whole. Rows are kept as they are, repeated ones too; rows with a null id are scored
and not held out. Columns with the names of the added ones are replaced. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import text_of, tidy
from trendloom.session import settle

BITS = 22
SAMPLE = 12_000  # labelled rows, about
PASSES = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.0
WORD = re.compile(r"\w+")
HELD_OUT = 2  # remainder of the id's checksum by 4
THRESHOLD = 0.3
KEPT_WORDS = 100_000  # of a worker, some 15 MB; the store starts anew beyond it

_hashes: dict[str, int] = {}


def features(text: str) -> np.ndarray:
    """Sorted distinct features of a text."""
    from xxhash import xxh3_64_intdigest

    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    for word in set(words).difference(_hashes):
        _hashes[word] = xxh3_64_intdigest(word)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    parts = [h]
    for gap in (1, 2, 3):  # pairs of words this far apart; neighbours are a kind of their own
        kind = np.uint64(0x9E3779B97F4A7C15 if gap == 1 else 0xC2B2AE3D27D4EB4F)
        parts.append((h[:-gap] ^ (h[:-gap] >> np.uint64(31))) * kind + h[gap:])
    mixed = np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed >> np.uint64(64 - BITS)).astype(np.int64)


def packed(found: np.ndarray) -> bytes:
    """Sorted features as compressed differences, a fifth of their size."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(np.diff(found, prepend=0).astype("<i4").tobytes())


class Unpacked:
    """Packed features, unpacked row by row in each pass over them."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows

    def __iter__(self) -> Iterator[np.ndarray]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        for row in self.rows:
            yield np.cumsum(np.frombuffer(unpack(row), "<i4"), dtype=np.int64)


def learn(rows: Iterable[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights, the bias as feature -1, after ``PASSES`` passes over the rows."""
    z = np.zeros((1 << BITS) + 1, np.float32)
    n = np.zeros((1 << BITS) + 1, np.float32)

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        rate = (BETA + np.sqrt(ns)) / ALPHA + L2
        zero = np.where(at == 1 << BITS, 0, L1)  # the bias is free
        return np.where(np.abs(zs) <= zero, 0, (np.sign(zs) * zero - zs) / rate)

    for _ in range(PASSES):
        for found, label in zip(rows, labels):
            at = np.append(found, 1 << BITS)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            square = np.float32(gradient * gradient)
            ns = n[at]
            sigma = (np.sqrt(ns + square) - np.sqrt(ns)) / ALPHA
            z[at] += np.float32(gradient) - sigma * w
            n[at] = ns + square
    used = np.flatnonzero((z > L1) | (z < -L1))
    used = np.union1d(used, [1 << BITS])
    w = weights(used)
    used, w = used[w != 0], w[w != 0]
    return np.where(used == 1 << BITS, -1, used), w


def held_out(key: Column) -> Column:
    checksum = F.crc32(key.cast("string").cast("binary"))
    return F.coalesce(checksum % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``feature`` and ``weight`` learnt from the labelled rows that are not held out."""
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))
    )
    order = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    known = settle(known.distinct())
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.withColumn("_order", order).filter(F.col("_order") < int(share * (1 << 30)))
    rows = (
        docs.select(F.col(key).alias("_id"), text_of(text).alias("text"))
        .join(F.broadcast(chosen), "_id")  # about ``sample`` rows of three numbers
        .groupBy("_order", "_id", "_label")
        .agg(F.min("text").alias("text"))  # one text per label
    )

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [packed(features(t.as_py())) for t in part.column("text")]
                columns = [part.column("_order"), part.column("_label")]
                names = ["_order", "_label", "features"]
                yield pa.record_batch([*columns, pa.array(found, pa.binary())], names=names)
        _hashes.clear()

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows, found = [], []
        for batch in batches:
            found += batch.column("_label").to_pylist()
            rows += batch.column("features").to_pylist()
        if len(set(found)) == 2:
            used, weights = learn(Unpacked(rows), found)
            columns = [pa.array(used, pa.int64()), pa.array(weights, pa.float64())]
            yield pa.record_batch(columns, names=["feature", "weight"])

    extracted = rows.mapInArrow(tidy(extract), "_order bigint, _label int, features binary")
    # a bounded sample: one task learns from it, in an order that rows alone decide
    one = extracted.repartition(1).sortWithinPartitions("_order", "_label", "features")
    return one.mapInArrow(tidy(fit), "feature bigint, weight double")


def score(
    docs: DataFrame, model: DataFrame, text: str = "text", name: str = "score", count: str = "n_features"
) -> DataFrame:
    """``docs`` with the probability of label 1 as column ``name`` and the number of features as
    ``count``; columns of these names are replaced."""
    fitted = model.collect()  # at most one row per coordinate, few after L1
    at = np.array([r["feature"] for r in fitted], np.int64)
    weights = np.array([r["weight"] for r in fitted], np.float64)
    order = np.argsort(at)
    at, weights = at[order], weights[order]
    shared = docs.sparkSession.sparkContext.broadcast((at, weights))
    kept = [c for c in docs.columns if c not in (name, count)]
    kind = docs.select(F.struct(*kept).alias("row")).schema["row"].dataType.simpleString()
    rows = docs.select(F.struct(*kept).alias("row"))  # the text travels once

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, weights = shared.value
        # where the weight of a feature is, 0 for none: some 700 of four million have one
        place = np.zeros((1 << BITS) + 1, np.uint16 if len(at) < 1 << 16 else np.uint32)
        place[at] = np.arange(1, len(at) + 1)  # the bias is feature -1, the last place
        listed = np.append(0.0, weights)
        bias = listed[place[-1]]
        for batch in batches:
            sums, sizes = [], []
            for t in batch.column("row").field(text):
                found = features(str(t.as_py() or ""))
                sums.append(listed[place[found]].sum() + bias)
                sizes.append(len(found))
            chances = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -500, 500)))
            columns = [batch.column("row"), pa.array(chances), pa.array(sizes, pa.int32())]
            yield pa.record_batch(columns, names=["row", name, count])
        _hashes.clear()

    return rows.mapInArrow(tidy(judge), f"row {kind}, {name} double, {count} int").select("row.*", name, count)


def rejected(chance: Column) -> Column:
    return chance >= THRESHOLD
