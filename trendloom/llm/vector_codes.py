"""Product quantisation of vectors in whole numbers, assigned by Walsh-Hadamard coefficients.

Components become whole numbers, vectors are cut into equal parts, and each part position has a
codebook, which starts from the vectors with the smallest ids and is improved by rounds of assigning
all parts and averaging. Rounds pass over the vectors on the executors; what comes back to the
driver are the sums per entry, whose number is fixed.

Parts and entries, filled up with zeros to a power of two, are transformed by the Walsh-Hadamard
matrix: sums and differences only, so whole numbers stay whole, and squared distances grow by exactly
that power of two. The transform gathers most of a smooth part in its coefficients of low
sequency (few changes of sign), so squared differences are added up in that order: the sum so far
never exceeds the whole, and an entry whose sum passes the distance of an entry known in full is
out. Entries that stay are compared in full, ties to the lower index.

All arithmetic is on whole numbers: 64 bits where the largest component allows it, Python's without
a bound otherwise. An error beyond 64 bits is null, and so is a label's sum with such an error.

Vectors that are null or hold null or non-finite components take no part. Repeated ids are rows of
their own; the codebooks start from the smallest ids, null ids last, equal ids by their vectors;
fewer vectors than entries give fewer entries. Shorter vectors, and lengths no multiple of the
parts, are filled up with zeros. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import settle

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LIMB = 40  # bits of the pieces in which sums travel


def whole_numbers(vectors: list[np.ndarray], width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * component) as a matrix of ``width`` columns: 64-bit if it fits well, else of
    Python's whole numbers."""
    values = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        values[row, : len(v)] = v
    if not values.size or np.abs(values).max() < (1 << 45) / scale:
        return np.floor(values * scale).astype(np.int64)
    out = np.zeros(values.shape, object)
    for place, x in np.ndenumerate(values):
        over, under = float(x).as_integer_ratio()
        out[place] = over * scale // under
    return out


def sequency_order(size: int) -> list[int]:
    """The rows of the Walsh-Hadamard matrix by their number of changes of sign."""
    bits = size.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(size)]
    return [int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row in the order of sequency, filled up with zeros to a
    power of two."""
    size = 1
    while size < parts.shape[1]:
        size *= 2
    out = np.zeros((len(parts), size), parts.dtype)
    out[:, : parts.shape[1]] = parts
    step = 1
    while step < size:
        pairs = out.reshape(len(parts), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        out = out.reshape(len(parts), size)
        step *= 2
    return out[:, sequency_order(size)]


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if their squared distances after the transform fit 64 bits, else as
    Python's whole numbers."""
    size = 1
    while size < arrays[0].shape[1]:
        size *= 2
    bound = isqrt((1 << 62) // size) // (2 * size)
    if all(a.dtype == np.int64 and (not a.size or np.abs(a).max() <= bound) for a in arrays):
        return list(arrays)
    return [a.astype(object) for a in arrays]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, ties to the lower, and the squared distance."""
    if not len(parts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts, entries = fitting(parts, entries)
    rows, books = transformed(parts), transformed(entries)
    size = rows.shape[1]
    first = max(1, size // 4)
    so_far = ((rows[:, None, :first] - books[None, :, :first]) ** 2).sum(axis=2)
    guess = so_far.argmin(axis=1)
    bound = ((rows - books[guess]) ** 2).sum(axis=1)  # an entry known in full
    row, entry = np.nonzero(so_far <= bound[:, None])
    total = so_far[row, entry]
    for at in range(first, size):
        total = total + (rows[row, at] - books[entry, at]) ** 2
        left = (total <= bound[row]).astype(bool)
        row, entry, total = row[left], entry[left], total[left]
    # every row still has its guess; the pairs are in the order of rows and entries
    least = np.minimum.reduceat(total, np.searchsorted(row, np.arange(len(rows))))
    best = (total == least[row]).astype(bool)
    _, place = np.unique(row[best], return_index=True)
    return entry[best][place], least // size


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number in pieces of ``LIMB`` bits that sum up by place without overflow."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        place += 1


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``v`` (array of double) and ``label`` of the vectors that take part."""
    rows = vectors.select(
        F.col(key).alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        F.col(label).alias("label"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("v").isNotNull() & finite)


def _matrix(column, width: int, scale: int) -> np.ndarray:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return whole_numbers([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], width, scale)


def entry_sums(rows: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """Sums per ``part``, ``entry`` and ``at`` (position; -1: number of parts), as ``limb`` and
    ``total``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    step = books[0].shape[1]

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = shared.value
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            values = _matrix(batch.column("v"), step * len(held), scale)
            for p, entries in enumerate(held):
                parts = values[:, p * step : (p + 1) * step]
                codes, _ = nearest(parts, entries)
                for e in np.unique(codes).tolist():
                    chosen = parts[codes == e]
                    for at, value in enumerate([*chosen.sum(axis=0).tolist(), len(chosen)]):
                        place = (p, e, -1 if at == step else at)
                        sums[place] = sums.get(place, 0) + value
        out = [(*place, limb, piece) for place, value in sums.items() for limb, piece in limbs(value)]
        if out:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            names = ["part", "entry", "at", "limb", "total"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    each = rows.select("v").mapInArrow(add, "part int, entry int, at int, limb int, total bigint")
    return each.groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebook of each part position: a matrix of whole numbers with a row per entry."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    step = max(1, -(-longest // parts))
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    first = whole_numbers([np.array(r["v"], float) for r in start], step * parts, scale)
    books = [first[:, p * step : (p + 1) * step] for p in range(parts)]
    if not len(first):
        return books
    for _ in range(rounds):
        sums: dict[tuple[int, int, int], int] = {}
        # parts x entries x positions rows, a few pieces each
        for r in entry_sums(rows, books, scale).collect():
            place = (r["part"], r["entry"], r["at"])
            sums[place] = sums.get(place, 0) + (int(r["total"]) << (LIMB * r["limb"]))
        books = [b.astype(object) for b in books]
        for (p, e, at), n in sums.items():
            if at == -1:
                books[p][e] = [sums.get((p, e, i), 0) // n for i in range(step)]
        small = [not b.size or max(map(abs, b.ravel())) < 1 << 62 for b in books]
        books = [b.astype(np.int64) if s else b for b, s in zip(books, small)]
    return books


def assign(rows: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``id``, ``label``, ``code`` (two hex digits per part) and ``error`` of every vector."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    step = books[0].shape[1]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = shared.value
        for batch in batches:
            values = _matrix(batch.column("v"), step * len(held), scale)
            digits = np.zeros((batch.num_rows, len(held)), np.uint8)
            error = [0] * batch.num_rows
            for p, entries in enumerate(held):
                codes, far = nearest(values[:, p * step : (p + 1) * step], entries)
                digits[:, p] = codes
                error = [e + f for e, f in zip(error, far.tolist())]
            codes = [row.tobytes().hex() for row in digits]
            errors = [e if e < 1 << 63 else None for e in error]
            yield pa.record_batch(
                [batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["id", "label", "code", "error"],
            )

    return rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def checksum(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(int(x)) for b in books for x in b.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE
) -> DataFrame:
    """Per vector that takes part: the key, ``code``, ``error``, ``label_error`` (the errors of
    equal labels summed, null labels together) and ``codebooks_sha256``."""
    rows = settle(usable(vectors, key, vector, label))
    books = train(rows, scale=scale)
    coded = settle(assign(rows, books, scale))
    # one row per label, summed before the shuffle and joined as a small table where it is one
    total = F.sum(F.col("error").cast("decimal(38, 0)"))
    most = F.lit((1 << 63) - 1).cast("decimal(38, 0)")
    whole = (F.count("*") == F.count("error")) & (total <= most)
    sums = settle(coded.groupBy("label").agg(F.when(whole, total.cast("long")).alias("label_error")))
    sums = sums.withColumnRenamed("label", "_label")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256")
    )
