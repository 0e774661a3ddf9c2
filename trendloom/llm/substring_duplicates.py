"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

A suffix matters through its first ``window`` bytes only. The sort goes over them by digits, the
most significant first, and whatever is alone in its group after a digit is out:

1. The first digit of a window is its least gram (by hash, at its first place). Windows in a row
   mostly have the same one, so a text becomes a few runs of windows: some 85 windows per row.
   Per digit the runs are counted; digits with one run are out.
2. The second digit is the content of the whole run. Groups with one content that occurs twice or
   more are done: all their windows are repeated.
3. In groups with several contents the bytes of the window are the digits. Contents travel once
   each, and their suffixes are sorted in the group's task by 8 bytes after 8 bytes, the most
   significant first, until ``window`` bytes agree. A group of more than ``LOCAL`` runs is dealt
   out further by the hash of the window instead, so no group is too large for a task.

Equal groups after the last digit are exactly the repeated windows. The first two digits only deal
suffixes out: equal windows have the same ones. Contents, and windows of groups beyond ``LOCAL``,
are told apart by 64-bit hashes within their digit.

Results belong to a text: rows of equal texts are found by its digest and length, and get the same
result. Null texts are empty, texts of fewer bytes than ``window`` lose nothing. What a removal
leaves may be no valid UTF-8; the text column replaces such bytes, ``kept`` has them as they are.
No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import text_of, tidy
from trendloom.session import settle

WINDOW = 200
LOCAL = 20_000  # runs of a group that one task sorts
TOGETHER = 1 << 19  # bytes of the contents of small groups sorted at once


def _texts(docs: DataFrame, text: str) -> DataFrame:
    whole = text_of(text)
    return docs.select(
        F.xxhash64(whole).alias("h"), F.octet_length(whole).alias("n"), whole.alias("text")
    )


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, as they are to be shuffled."""
    kept = [f for f in rows.schema if f.name != "text"]

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [squeeze(t.as_py().encode()) for t in batch.column("text")]
            columns = [batch.column(f.name) for f in kept]
            yield pa.record_batch(
                [*columns, pa.array(texts, pa.binary())], names=[*(f.name for f in kept), "packed"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(tidy(pack), f"{fields}, packed binary")


def text_runs(texts: DataFrame, window: int) -> DataFrame:
    """First pass: ``h``, ``n``, ``start``, ``count``, ``digit`` and ``content`` of every run."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        from trendloom.llm.suffixes import runs

        names = ["h", "n", "start", "count", "digit", "content"]
        for batch in batches:
            h, n = (batch.column(c).to_numpy() for c in ("h", "n"))
            for at in range(0, batch.num_rows, 1000):
                found = [t.as_py().encode() for t in batch.column("text").slice(at, 1000)]
                for number, start, count, digit, spans in runs(found, window):
                    content = np.array([xxh3_64_intdigest(s) for s in spans], np.uint64)
                    columns = [
                        h[at + number],
                        n[at + number],
                        start,
                        count.astype(np.int32),
                        digit.view(np.int64),
                        content.view(np.int64),
                    ]
                    yield pa.record_batch([pa.array(c) for c in columns], names=names)

    return texts.mapInArrow(
        tidy(cut), "h bigint, n int, start bigint, count int, digit bigint, content bigint"
    )


def shared_runs(found: DataFrame) -> DataFrame:
    """Second pass: the runs whose digit another run has, with ``runs`` (of the digit) and
    ``mixed`` (there are several contents)."""
    digits = (
        found.groupBy("digit")
        .agg(
            F.count("*").alias("runs"),
            (F.min("content") != F.max("content")).alias("mixed"),
        )
        .filter("runs > 1")
    )
    return found.join(digits, "digit")


def with_bytes(texts: DataFrame, contents: DataFrame, window: int) -> DataFrame:
    """``digit``, ``content``, ``runs`` and ``bytes`` of the contents (with ``h``, ``n``, ``start``
    and ``count`` of one of their runs)."""
    listed = contents.groupBy("h", "n").agg(
        F.collect_list(F.struct("digit", "content", "runs", "start", "count")).alias("wanted")
    )
    unique = _packed(texts).dropDuplicates(["h", "n"])
    joined = unique.join(listed, ["h", "n"]).select("packed", "wanted")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["digit", "content", "runs", "bytes"]
        for batch in batches:
            for packed, wanted in zip(batch.column("packed"), batch.column("wanted")):
                text = unpack(packed.as_py())
                rows = [
                    (
                        w["digit"],
                        w["content"],
                        w["runs"],
                        text[w["start"] : w["start"] + w["count"] + window - 1],
                    )
                    for w in wanted.as_py()
                ]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return joined.mapInArrow(tidy(cut), "digit bigint, content bigint, runs bigint, bytes binary")


def sorted_in_tasks(contents: DataFrame, window: int) -> DataFrame:
    """Last pass for groups of bounded size: ``digit``, ``content``, ``first``, ``last``: the
    stretches of windows (numbers in the run, ``last`` excluded) that another content has."""
    dealt = contents.select("digit", "content", "bytes").repartition("digit")

    def sort(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from trendloom.llm.suffixes import repeated, stretches

        names = ["digit", "content", "first", "last"]

        def rows() -> Iterator:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("digit", "content", "bytes")))

        def marked(held: list[tuple[int, int, bytes]]) -> Iterator:
            digit = np.array([d for d, _, _ in held])
            number = np.cumsum(np.append(False, digit[1:] != digit[:-1]))
            found = repeated([data for _, _, data in held], number, window)
            out = [(d, c, a, b) for (d, c, _), f in zip(held, found) for a, b in stretches(f)]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        held: list[tuple[int, int, bytes]] = []
        size = 0
        for _, group in groupby(rows(), key=lambda r: r[0]):
            if size > TOGETHER:
                yield from marked(held)
                held, size = [], 0
            for row in group:
                held.append(row)
                size += len(row[2])
        if held:
            yield from marked(held)

    return dealt.sortWithinPartitions("digit").mapInArrow(
        tidy(sort), "digit bigint, content bigint, first bigint, last bigint"
    )


def sorted_by_shuffle(contents: DataFrame, window: int) -> DataFrame:
    """The same for groups of any size: windows meet by their hashes."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from trendloom.llm.suffixes import mix, polynomial

        for batch in batches:
            for row in batch.to_pylist():
                hashes = mix(polynomial(np.frombuffer(row["bytes"], np.uint8), window))
                k = len(hashes)
                yield pa.record_batch(
                    [
                        pa.array(np.full(k, row["digit"])),
                        pa.array(np.full(k, row["content"])),
                        pa.array(np.arange(k)),
                        pa.array(hashes.view(np.int64)),
                    ],
                    names=["digit", "content", "first", "hash"],
                )

    windows = contents.select("digit", "content", "bytes").mapInArrow(
        tidy(cut), "digit bigint, content bigint, first bigint, hash bigint"
    )
    several = (
        windows.groupBy("digit", "hash")
        .agg(F.min("content").alias("_low"), F.max("content").alias("_high"))
        .filter("_low <> _high")
        .select("digit", "hash")
    )
    return windows.join(several, ["digit", "hash"], "left_semi").select(
        "digit", "content", "first", (F.col("first") + 1).alias("last")
    )


def repeated_spans(texts: DataFrame, window: int = WINDOW, local: int = LOCAL) -> DataFrame:
    """``h``, ``n`` and ``spans`` (array of byte ranges ``first``, ``last``, which may overlap) of
    the texts with repeated windows. ``texts`` has ``h``, ``n`` and ``text``."""
    shared = settle(shared_runs(text_runs(texts, window)))
    whole = shared.filter("not mixed").select(
        "h", "n", F.col("start").alias("first"), (F.col("start") + F.col("count")).alias("last")
    )
    mixed = shared.filter("mixed")
    contents = settle(
        mixed.groupBy("digit", "content").agg(
            F.count("*").alias("times"),
            F.min(F.struct("h", "n", "start", "count", "runs")).alias("one"),
        )
    )
    data = settle(with_bytes(texts, contents.select("digit", "content", "one.*"), window))
    stretch = sorted_in_tasks(data.filter(F.col("runs") <= local), window).unionByName(
        sorted_by_shuffle(data.filter(F.col("runs") > local), window)
    )
    # a content that occurs twice is repeated as a whole, whatever the others are
    again = contents.filter("times > 1").select(
        "digit", "content", F.lit(0).cast("long").alias("first"), F.col("one.count").cast("long").alias("last")
    )
    known = settle(
        stretch.unionByName(again)
        .groupBy("digit", "content")
        .agg(F.collect_list(F.struct("first", "last")).alias("found"))
    )
    parts = mixed.join(known, ["digit", "content"]).select("h", "n", "start", F.explode("found").alias("x"))
    partly = parts.select(
        "h", "n", (F.col("start") + F.col("x.first")).alias("first"), (F.col("start") + F.col("x.last")).alias("last")
    )
    windows = whole.unionByName(partly)
    return windows.groupBy("h", "n").agg(
        F.collect_set(F.struct("first", (F.col("last") + (window - 1)).alias("last"))).alias("spans")
    )


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    local: int = LOCAL,
    with_kept: bool = True,
) -> DataFrame:
    """Every row of ``docs`` without the bytes that repeated windows cover.

    All columns but the text, which is replaced; added are ``n_bytes``, ``n_removed``, ``n_spans``
    (long), ``kept_sha256`` and, unless ``with_kept`` is false (then without the text, too),
    ``kept`` (binary). Columns of those names are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    spans = settle(repeated_spans(_texts(docs, text), window, local))
    others = [c for c in docs.columns if c not in (*added, text)]
    rows = docs.select(
        F.struct(*others).alias("row"),
        F.xxhash64(text_of(text)).alias("h"),
        F.octet_length(text_of(text)).alias("n"),
        text_of(text).alias("text"),
    )
    joined = _packed(rows).join(spans, ["h", "n"], "left").select("row", "packed", "spans")
    kind = docs.select(F.struct(*others).alias("row")).schema["row"].dataType.simpleString()

    def take(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for packed, found in zip(part.column("packed"), part.column("spans")):
                    data = unpack(packed.as_py())
                    ranges = sorted((s["first"], s["last"]) for s in found.as_py() or ())
                    parts, end, last, count = [], 0, -1, 0
                    for a, b in ranges:
                        if a > last:
                            parts.append(data[end:a])
                            count += 1
                        last = max(last, b)
                        end = last
                    parts.append(data[end:])
                    kept = b"".join(parts)
                    digest = hashlib.sha256(kept).hexdigest()
                    out.append((len(data), len(data) - len(kept), count, digest, kept if with_kept else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.record_batch([part.column("row"), *columns], names=["row", *added])

    schema = f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    result = joined.mapInArrow(tidy(take), schema).select("row.*", *added)
    if not with_kept:
        return result.drop("kept")
    whole = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string"))
    return result.withColumn(text, F.coalesce(whole, F.make_valid_utf8(F.col("kept").cast("string"))))
