"""Token ids in Arrow files of equal-length sequences with masks.

A shard is one Arrow IPC file. Its batches hold three fixed-size lists per sequence: ``ids`` (16
bits if the vocabulary allows it, else 32), ``mask`` (false in the padding after the last token of
the shard) and ``starts`` (true where a document begins). Batches are neither compressed nor
nested, so a reader maps the file and gets the ids of any sequence without copying.

Documents follow each other in ascending order of their key, each ended by ``end_id``; the shards
follow each other in the same order. Rows are range-partitioned, so no task sees more than its
range, and streamed through the task, so memory does not grow with the shard. A task names its
file afresh on every attempt and hands back the name with its rows; files of lost attempts are
never listed in the index and so never read.

Null texts count as empty (one end id each); null keys come first; rows with equal keys follow
each other by text; repeated rows are kept; no rows give an index without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import file_system, new_file, pieces_of, text_of
from trendloom.llm.tokens import encoder
from trendloom.session import settle, work_dir

SEQUENCE = 2048
SHARD_BYTES = 32 << 20  # of text
BATCH_SEQUENCES = 128
KEPT_PIECES = 600_000  # about the distinct pieces of a shard, some 120 MB, so that each is merged once


class SequenceWriter:
    """Cuts a stream of ids into equal-length sequences and writes them batch by batch."""

    def __init__(self, uri: str, length: int, wide: bool) -> None:
        import pyarrow as pa

        self.length, self.dtype = length, "<u4" if wide else "<u2"
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema(
            [
                ("ids", pa.list_(item, length)),
                ("mask", pa.list_(pa.bool_(), length)),
                ("starts", pa.list_(pa.bool_(), length)),
            ]
        )
        system, path = file_system(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = system.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list = []
        self.begins: list[int] = []
        self.waiting = 0

    def add(self, ids) -> None:
        self.begins.append(self.waiting)
        self.parts.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= self.length * BATCH_SEQUENCES:
            self._write(self.waiting - self.waiting % (self.length * BATCH_SEQUENCES))

    def _write(self, upto: int) -> None:
        import numpy as np
        import pyarrow as pa

        ids = np.concatenate(self.parts)
        begins = np.array(self.begins, np.int64)
        rows = pieces_of(upto, self.length)
        size = rows * self.length
        filled = np.zeros(size, ids.dtype)
        filled[:upto] = ids[:upto]
        starts = np.zeros(size, bool)
        starts[begins[begins < upto]] = True
        columns = [filled, np.arange(size) < upto, starts]
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
            for values, field in zip(columns, self.schema)
        ]
        for at in range(0, rows, BATCH_SEQUENCES):
            batch = [a.slice(at, BATCH_SEQUENCES) for a in arrays]
            self.out.write_batch(pa.record_batch(batch, schema=self.schema))
        self.parts = [ids[upto:]]
        self.begins = (begins[begins >= upto] - upto).tolist()
        self.waiting -= upto

    def close(self) -> None:
        if self.waiting:
            self._write(self.waiting)
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to one shard; ids come as views of the mapped file."""

    def __init__(self, uri: str) -> None:
        import pyarrow as pa

        system, path = file_system(uri)
        self.source = system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, n: int) -> dict:
        """Sequence ``n`` of the shard as arrays ``ids``, ``mask`` and ``starts``."""
        batch = self.file.get_batch(n // BATCH_SEQUENCES)
        row = n % BATCH_SEQUENCES
        return {
            name: batch.column(name)[row].values.to_numpy(zero_copy_only=name == "ids")
            for name in ("ids", "mask", "starts")
        }

    def span(self, position: int, count: int):
        """``count`` ids from ``position`` of the shard's stream on."""
        import numpy as np

        each = self.length * BATCH_SEQUENCES
        parts, at, end = [], position, position + count
        while at < end:
            # flatten() respects the batch's offset and copies nothing
            values = self.file.get_batch(at // each).column("ids").flatten()
            inside = at % each
            take = min(end - at, each - inside)
            parts.append(values.slice(inside, take).to_numpy(zero_copy_only=True))
            at += take
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, "<u2")])


def write_sequences(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE,
    end_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
    folder: str | None = None,
    added: bool = False,
) -> DataFrame:
    """Write the tokens of all documents; the index has a row per document. With ``added``,
    strings of added tokens get their ids.

    Index columns: the key, ``shard`` (int), ``file``, ``position`` (long, in the shard's stream),
    ``n_tokens`` (long, with the end id).
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "sequences")
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0]
    order = ["key", F.xxhash64("text")]
    ranged = rows.repartitionByRange(pieces_of(size, shard_bytes), *order)

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = new_file(folder, f"shard-{shard:06d}") + ".arrow"
        encode = encoder(tokenizer, added, KEPT_PIECES)
        wide = max(encode.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        out, position = None, 0
        for batch in batches:
            sizes, positions = [], []
            for value in batch.column("text"):
                out = out or SequenceWriter(name, length, wide)
                ids = np.frombuffer(encode.encode(value.as_py()), "<u4")
                out.add(np.append(ids, np.uint32(end_id)))
                positions.append(position)
                sizes.append(len(ids) + 1)
                position += len(ids) + 1
            n = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column("key"),
                    pa.array([shard] * n, pa.int32()),
                    pa.array([name] * n, pa.string()),
                    pa.array(positions, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["key", "shard", "file", "position", "n_tokens"],
            )
        if out:
            out.close()

    kind = rows.schema["key"].dataType.simpleString()
    index = ranged.sortWithinPartitions("key", "text").mapInArrow(
        write, f"key {kind}, shard int, file string, position bigint, n_tokens bigint"
    )
    return settle(index.withColumnRenamed("key", key))


def read_documents(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of every document, read back from the shards.

    Columns: the key, ``shard``, ``start`` (long: ids of all documents before it), ``n_tokens``
    and ``ids`` (binary, little-endian unsigned 32-bit).
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, SequenceFile] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = []
                for row in part.select(["file", "position", "n_tokens"]).to_pylist():
                    if row["file"] not in held:
                        held = {row["file"]: SequenceFile(row["file"])}
                    found = held[row["file"]].span(row["position"], row["n_tokens"])
                    ids.append(found.astype("<u4").tobytes())
                names = ["key", "shard", "start", "n_tokens"]
                kept = [part.column(c) for c in names]
                yield pa.record_batch([*kept, pa.array(ids, pa.binary())], names=[*names, "ids"])

    # one row per shard, so the running sum is over few rows; joined before the ids are read
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    placed = (
        index.withColumnRenamed(key, "key")
        .join(offsets, "shard")
        .withColumn("start", F.col("before") + F.col("position"))
        .repartition(shards, "shard")  # rows are small, what they stand for is not
        .sortWithinPartitions("shard", "position")
    )
    kind = index.schema[key].dataType.simpleString()
    found = placed.mapInArrow(
        read, f"key {kind}, shard int, start bigint, n_tokens bigint, ids binary"
    )
    return found.withColumnRenamed("key", key)
