"""Rows that travel in parcels: Parquet pages of many rows, coded by column, in place of a row each.

A shuffled row of a term takes about 20 bytes, in a parcel of sorted terms about 4. Rows of one part
meet in one task, part by part; there are more parts than tasks, so that a part stays small.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS_PER_TASK = 4
BATCH_BYTES = 1 << 25  # of the rows that are dealt out together


def parts_for(spark: SparkSession) -> int:
    return PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(rows: pa.Table) -> bytes:
    """Texts by what they share with the one before, lists and numbers with a fraction by their distinct values."""
    flat = {f.name: f.type for f in rows.schema}
    texts = {n: "DELTA_BYTE_ARRAY" for n, t in flat.items() if pa.types.is_string(t) or pa.types.is_large_string(t)}
    values = [n for n, t in flat.items() if pa.types.is_floating(t)]
    values += [f"{n}.list.element" for n, t in flat.items() if pa.types.is_list(t)]
    sink = io.BytesIO()
    pq.write_table(rows, sink, compression="zstd", use_dictionary=values, column_encoding=texts or None, write_statistics=False)
    return sink.getvalue()


def unpacked(parcels: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pq.read_table(pa.BufferReader(p), use_threads=False) for p in parcels]).combine_chunks()


def dealt(rows: pa.Table, part: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each part, in the order they came in."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    rows = rows.take(pa.array(order))
    edges = np.nonzero(np.diff(part, prepend=-1))[0]
    for low, high in zip(edges, np.append(edges[1:], len(part))):
        yield int(part[low]), rows.slice(low, high - low)


def gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes from batches of any size."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for low in range(0, batch.num_rows, step):
            piece = batch.slice(low, step)
            held.append(piece)
            size += piece.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def deal(rows: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """(part, parcel): the rows by a hash of their keys. Rows in order of a text pack best."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BATCH_BYTES):
            part = table["_part"].to_numpy()
            yield from sent(dealt(table.drop_columns(["_part"]), part))

    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("_part")
    return rows.select("*", part).mapInArrow(pack, "part int, parcel binary")


def sent(tables: Iterable[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
    for part, rows in tables:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "parcel": pa.array([packed(rows)], pa.binary())})


def meet(parcels: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each part."""
    return parcels.groupBy("part").applyInArrow(lambda rows: work(unpacked(rows["parcel"].to_pylist())), schema)
