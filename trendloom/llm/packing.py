"""Best-fit packing by minimum bin slack.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. All that packing needs
to know is how many pieces there are of each length: at most ``capacity`` counts, however large
the corpus. On these counts the driver fills bins one after the other: the longest piece left goes
in, a subset-sum over the lengths left (a big integer as bitset) finds the fullest combination for
the rest, and that combination is taken as often as the counts allow. The result is a list of
runs "pieces ``first`` to ``first + count`` of this length lie in these bins at this offset",
whose size is bounded by the capacity alone; tasks look their pieces up in it by the piece's rank
among those of its length. Ranks come from counts per length and salt, so a length that a third of
all pieces share is no hot group.

Null texts are empty: one piece with the end id alone. Repeated rows are packed each. No rows, no
bins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import pieces_of, text_of, tidy
from trendloom.llm.tokens import Encoder, encoder
from trendloom.session import settle

CAPACITY = 2048
RANKED_ROWS = 500_000  # of a length, in one salt


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    added: bool = False,
    kept: int | None = None,
) -> DataFrame:
    """The documents' ids, cut where longer than ``capacity``; the first piece takes the rest.
    With ``added``, strings of added tokens get their ids. With ``kept``, workers store the ids of so
    many pieces of text from task to task; else a small store goes with its task.

    Columns: the key, ``piece`` (int, from 0), ``start`` and ``length`` (long) and ``ids``
    (binary, little-endian unsigned 32-bit).
    """
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # some 50 MB without ``kept``, gone when the task ends
        encode = (encoder(tokenizer, added, kept) if kept else Encoder(tokenizer, added)).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                taken, piece, start, ids = [], [], [], []
                for row, value in enumerate(part.column("text")):
                    found = encode(value.as_py()) + end
                    n = len(found) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        taken.append(row)
                        piece.append(i)
                        start.append(a)
                        ids.append(found[4 * a : 4 * b])
                yield pa.record_batch(
                    [
                        part.column("key").take(pa.array(taken, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["key", "piece", "start", "length", "ids"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids binary"
    return rows.mapInArrow(tidy(cut), schema).withColumnRenamed("key", key)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with their numbers, that fill most of ``room``; longer ones first."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps = []
    for length in sorted((x for x in left if x <= room), reverse=True):
        most, take = min(left[length], room // length), 1
        while most:
            take = min(take, most)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            most -= take
            take *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # only with this step
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, count, per bin, first bin, offset): where the pieces of each length go."""
    left = {x: n for x, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    runs, bins = [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        used = fullest({x: n for x, n in left.items() if n}, capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            runs.append((length, done[length], times * n, n, bins, offset))
            offset += length * n
            done[length] += times * n
            left[length] -= times * n
            if not left[length]:
                del left[length]
        bins += times
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to rows with a ``length`` from 1 to ``capacity``.

    The rows are read more than once, so ``pieces`` is written out first. ``order`` says which
    of the pieces of a length come first.
    """
    settled = settle(pieces)
    counts = {r[0]: r[1] for r in settled.groupBy("length").count().collect()}  # <= capacity rows
    runs = minimum_slack(counts, capacity)
    salts = pieces_of(max(counts.values(), default=0), RANKED_ROWS) * 16
    salted = settled.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    groups = ["length", "_salt"]
    sizes = salted.groupBy(*groups).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy(*groups).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    ranked = (
        salted.withColumn("_place", F.row_number().over(place) - 1)
        .join(offsets, groups)
        .withColumn("_rank", F.col("_before") + F.col("_place"))
        .select(*settled.columns, "_rank")
    )

    names = settled.columns

    def look_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.array(sorted(runs), np.int64).reshape(-1, 6)
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            run = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            bin_of, slot = np.divmod(rank - run[:, 1], run[:, 3])
            columns = [batch.column(c) for c in names]
            placed = [pa.array(run[:, 4] + bin_of), pa.array(run[:, 5] + slot * length)]
            yield pa.record_batch([*columns, *placed], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in settled.schema)
    return ranked.mapInArrow(look_up, f"{fields}, sequence_id bigint, offset bigint")
