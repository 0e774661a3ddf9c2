"""Exact top-k inner products on a bit-sliced index.

Vectors of whole numbers are dealt into blocks of about ``BLOCK`` rows. Per block the index stores
one bitmap per dimension and bit: bit b of (component minus the block's least component), a bit per
row. The score of a query against all rows of a block is then a sum of slices with weights: each
dimension's slices, shifted by the set bits of the query's component, are added with full adders on
whole bitmaps (three bitmaps of one weight become one of that weight and one of the next). A
negative component adds the complement of the slices, so that all terms stay positive; the
difference is one number per query.

The best rows are then read off from the most significant slice of the sum downwards: as long as
more than k rows would be left, rows with a zero in the slice are put aside. Rows still equal when
the slices are used up are the boundary; of these the smallest ids are taken. No score is
approximate, so the recall is 1.

Blocks of queries are paired with blocks of the index: the stated query set against all rows. Each
pair yields at most k rows per query, from which the best k are ranked.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an
id. Shorter vectors count as filled up with zeros; vectors of no components score 0. Every row is a
candidate and, if its id is asked for, a query of its own, also rows that repeat an id; a query
leaves out itself only. Vectors with a component beyond ``LARGEST`` are kept beside the slices of
their block and scored in whole numbers without a bound; a score beyond 64 bits is ranked, but null.
Other columns are not read. No rows give no ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import pieces_of
from trendloom.session import settle

BLOCK = 8192  # rows
QUERIES = 256  # per block of queries
TOGETHER = 4  # blocks of queries that one task takes to a block of the index
LARGEST = 1 << 24
LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v``: floor(scale * component), as whole numbers in array<double>, of the vectors
    that count. The scale is a power of two, so that nothing is rounded."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    rows = vectors.select(F.col(key).alias("id"), scaled.alias("v")).filter(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # floor() of doubles gives bigint, which large ones pass; they are whole beyond 2**53 anyway
    return rows.select(
        "id",
        F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("v"),
    )


def bitmaps(values: np.ndarray, bits: int) -> np.ndarray:
    """Slices [bit, word] of non-negative whole numbers, 64 rows to a word."""
    words = -(-len(values) // 64)
    slices = np.zeros((bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((values >> b & 1).astype(bool), bitorder="little")
        slices[b, : len(packed)] = packed
    return slices.view(np.uint64)


def add_up(terms: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of the sum, least significant first. ``terms``: by weight, stacks of bitmaps."""
    total: list[np.ndarray] = []
    weight, last = 0, max(terms, default=-1)
    while weight <= last or weight in terms:
        parts = terms.pop(weight, [])
        stack = np.concatenate(parts) if parts else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                either = a ^ b
                carry = (a & b) | (either & c)
                stack = np.concatenate([either ^ c, stack[3 * n :]])
            else:
                carry = stack[:1] & stack[1:2]
                stack = stack[:1] ^ stack[1:2]
            terms.setdefault(weight + 1, []).append(carry)
        total.append(stack[0] if stack is not None else None)
        weight += 1
    return total


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_rows(total: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows with the largest sums; among equals the first rows."""
    sure, open_rows = np.zeros_like(allowed), allowed
    left = min(k, int(np.bitwise_count(allowed).sum()))
    for level in reversed(total):
        if left == 0:
            break
        if level is None:
            continue
        high = open_rows & level
        n = int(np.bitwise_count(high).sum())
        if n > left:
            open_rows = high
        else:
            sure, open_rows, left = sure | high, open_rows & ~level, left - n
    return np.concatenate([rows_of(sure), rows_of(open_rows)[:left]])


def ordered(score: int) -> tuple[int, str | None]:
    """Side (1: beyond the long numbers, -1: below them, else 0) and, beside 0, a text that orders
    whole numbers of that side like their size."""
    if -LONG <= score < LONG:
        return 0, None
    digits = f"{len(str(abs(score))):06d}{abs(score)}"
    if score > 0:
        return 1, digits
    return -1, digits.translate(str.maketrans("0123456789", "9876543210")) + "~"


class Index:
    """One block: rows in ascending order of ids and, for those of moderate components, the slices
    of each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        order = np.lexsort((rows, ids))
        wide = np.array([bool(len(v)) and np.abs(v).max() > LARGEST for v in vectors], bool)
        self.wide = [(int(rows[i]), ids[i], [int(x) for x in vectors[i]]) for i in order if wide[i]]
        order = order[~wide[order]]
        dims = max((len(vectors[i]) for i in order), default=0)
        self.rows, self.ids = rows[order], ids[order]
        self.values = np.zeros((len(order), dims), np.int64)
        for place, i in enumerate(order):
            self.values[place, : len(vectors[i])] = vectors[i]
        values = self.values
        self.least = int(values.min()) if values.size else 0
        self.bits = max(1, int(values.max() - self.least).bit_length()) if values.size else 1
        self.slices = [bitmaps(values[:, d] - self.least, self.bits) for d in range(dims)]
        self.all = bitmaps(np.ones(len(order), np.int64), 1)[0]

    def search(self, query_row: int, query: np.ndarray, k: int) -> list[tuple]:
        """Id, row and score of the best k rows but the query's own, and perhaps some more."""
        width = min(self.values.shape[1], len(query))
        if len(query) and np.abs(query).max() > LARGEST:
            whole = [int(x) for x in query[:width]]
            kept = self.rows != query_row
            scores = self.values[kept, :width].astype(object) @ np.array(whole, object) if width else [0] * int(kept.sum())
            found = [(i, r, int(x)) for i, r, x in zip(self.ids[kept], self.rows[kept].tolist(), scores)]
        else:
            query = query.astype(np.int64)
            rows = self._best(query_row, query, k)
            scores = self.values[rows, :width] @ query[:width]
            found = list(zip(self.ids[rows], self.rows[rows].tolist(), scores.tolist()))
        for row, name, vector in self.wide:
            if row != query_row:
                found.append((name, row, sum(a * int(b) for a, b in zip(vector, query))))
        if len(found) > k:
            found = sorted(found, key=lambda f: (-f[2], f[0], f[1]))[:k]
        return found

    def _best(self, query_row: int, query: np.ndarray, k: int) -> np.ndarray:
        allowed = self.all.copy()
        for own in np.flatnonzero(self.rows == query_row).tolist():
            allowed[own // 64] &= ~np.uint64(1 << own % 64)
        terms: dict[int, list[np.ndarray]] = {}
        for slices, factor in zip(self.slices, query.tolist()):
            used = slices if factor > 0 else ~slices
            size = abs(factor)
            for shift in range(size.bit_length()):
                if size >> shift & 1:
                    for b in range(self.bits):
                        terms.setdefault(shift + b, []).append(used[b : b + 1])
        return best_rows(add_up(terms), allowed, k)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows with a ``block``: about ``size`` rows each, by a hash of their number."""
    n = pieces_of(rows.count(), size)
    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score`` (long) for the queries.

    ``vectors`` has ``id`` and ``v`` (see ``quantised``); ``is_query`` is a condition on ``id``.
    """
    # ids may repeat, numbers given once and written do not
    rows = settle(vectors.withColumn("row", F.monotonically_increasing_id()))
    kind = rows.schema["id"].dataType.simpleString()
    index = blocks(rows, BLOCK).groupBy("block").agg(
        F.collect_list(F.struct("row", "id", "v")).alias("members")  # about BLOCK rows
    )
    asked = rows.filter(is_query)
    groups = pieces_of(asked.count(), QUERIES)
    shares = pieces_of(groups, TOGETHER)
    queries = (
        blocks(asked, QUERIES)
        .groupBy("block")
        .agg(F.collect_list(F.struct("row", "id", "v")).alias("queries"))
        .select("queries", F.pmod("block", F.lit(shares)).alias("share"))
    )
    n = pieces_of(rows.count(), BLOCK)
    # pairs of blocks are dealt out by both, so that the tasks grow with queries and rows
    paired = queries.select(
        "queries", "share", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")
    ).join(
        index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), ["block", "share"]
    )

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: tuple = (None, None)
        names = ["query_row", "query_id", "vec_id", "row", "score", "side", "beyond"]
        for batch in batches:
            id_type = batch.schema.field("members").type.value_type.field("id").type
            kinds = [pa.int64(), id_type, id_type, pa.int64(), pa.int64(), pa.int32(), pa.string()]
            for at in range(batch.num_rows):
                block = batch.column("block")[at].as_py()
                if held[0] != block:
                    members = batch.column("members")[at].values
                    ids = members.field("id").to_numpy(zero_copy_only=False)
                    numbers = members.field("row").to_numpy(zero_copy_only=False)
                    lists = members.field("v")
                    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                    vectors = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                    held = (block, Index(numbers, ids, vectors))
                found = []
                for q in batch.column("queries")[at].as_py():
                    for name, row, score in held[1].search(q["row"], np.array(q["v"], float), k):
                        side, beyond = ordered(score)
                        found.append((q["row"], q["id"], name, row, None if side else score, side, beyond))
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    found = paired.mapInArrow(
        search,
        f"query_row bigint, query_id {kind}, vec_id {kind}, row bigint, score bigint, side int, beyond string",
    )
    best = [F.desc("side"), F.desc("score"), F.desc("beyond"), F.asc("vec_id"), F.asc("row")]
    window = Window.partitionBy("query_row").orderBy(*best)
    ranked = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
