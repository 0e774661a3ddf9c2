"""Conversations rendered by a compiled template, with the loss mask of what the model says.

Turns are dealt out by conversation and sorted, and each task streams them through the template: a
conversation is never held whole, however many turns it has. The output comes in chunks of whole
turns, about ``CHUNK`` characters each, with the learnt spans of the chunk.

A template marks turns; texts are escaped so that no marker can occur inside them: ``escape`` puts
a backslash before every backslash, ``<``, ``#`` and ``:``, and reading takes it away again.

Rows go by turn, null turns first, equal turns by role and text; repeated rows are turns of their
own. Null roles and texts are empty. Rows without a conversation id form one conversation with a
null id. Texts may have any length; a chunk is longer where one turn is. Other columns are not read.
No rows give no conversations. The rows of one conversation are one ordered text and so
stay in one task, which reads them as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import text_of
from trendloom.llm.templates import compile_template
from trendloom.session import settle

CHUNK = 1 << 16
TURN, MIDDLE, END = "### ", ": ", "</turn>\n"
TEMPLATE = (
    "{% for message in messages %}{% turn %}"
    f"{{{{ '{TURN}' ~ (message.role|escape) ~ '{MIDDLE}' }}}}"
    "{% if message.role == 'assistant' %}"
    "{% generation %}{{ message.text|escape }}{% endgeneration %}"
    "{% else %}{{ message.text|escape }}{% endif %}"
    f"{END}"
    "{% endturn %}{% endfor %}"
)
SPECIAL = re.compile(r"([\\<#:])")
ESCAPED = re.compile(r"\\(.)", re.S)
# a turn as TEMPLATE writes it: the only unescaped marks are its own
READ = re.compile(r"### ((?:[^\\<#:]|\\.)*): ((?:[^\\<#:]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _rows(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def chunks(pieces: Iterator[tuple[str, bool | None]], size: int) -> Iterator[tuple[str, list[int]]]:
    """Rendered text in chunks of whole turns, whose ends the template marks, and the learnt spans
    as [from, to, …]."""
    parts: list[str] = []
    at, spans = 0, []
    for text, learnt in pieces:
        if learnt:
            spans += [at, at + len(text)]
        parts.append(text)
        at += len(text)
        if at >= size and learnt is None:
            yield "".join(parts), spans
            parts, at, spans = [], 0, []
    if parts:
        yield "".join(parts), spans


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, chunk: int = CHUNK
) -> DataFrame:
    """Columns ``conv_id``, ``chunk`` (int, from 0), ``formatted`` and ``learnt`` (array of
    character positions in the chunk: from, to, from, to …)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator) -> Iterator:
        import pyarrow as pa

        show = compile_template(template, {"escape": escape})
        kinds = [None, pa.int32(), pa.string(), pa.list_(pa.int32())]

        def as_batch(found: list, id_type: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(c, k or id_type) for c, k in zip(zip(*found), kinds)]
            return pa.record_batch(arrays, names=["conv_id", "chunk", "formatted", "learnt"])

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("conv_id").type

        def all_batches() -> Iterator:
            yield first
            yield from batches

        found, size = [], 0
        for conv, messages in groupby(_rows(all_batches()), key=lambda r: r["conv_id"]):
            for n, (text, spans) in enumerate(chunks(show({"messages": messages}), chunk)):
                found.append((conv, n, text, spans))
                size += len(text)
                if size > 4 << 20 or len(found) == 5000:
                    yield as_batch(found, id_type)
                    found, size = [], 0
        if found:
            yield as_batch(found, id_type)

    schema = f"conv_id {kind}, chunk int, formatted string, learnt array<int>"
    return dealt.mapInArrow(render, schema)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted chunks hold, one row per conversation.

    ``n_turns``, ``turns_sha256`` (role, newline, text, newline of each turn), ``loss_chars`` and
    ``loss_sha256`` (of all learnt text, unescaped) and ``formatted_chars``. Raises if a chunk
    holds anything but turns.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        names = [
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
        ]
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("conv_id").type
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def all_batches() -> Iterator:
            yield first
            yield from batches

        found = []
        for conv, parts in groupby(_rows(all_batches()), key=lambda r: r["conv_id"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = learnt = size = 0
            for part in parts:
                text, spans, at = part["formatted"], part["learnt"], 0
                while at < len(text):
                    turn = READ.match(text, at)
                    if turn is None:
                        raise ValueError(f"conversation {conv}: no turn at {at}")
                    turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                    n, at = n + 1, turn.end()
                for a, b in zip(spans[::2], spans[1::2]):
                    said = unescape(text[a:b])
                    learnt += len(said)
                    loss.update(said.encode())
                size += len(text)
            found.append((conv, n, turns.hexdigest(), learnt, loss.hexdigest(), size))
            if len(found) == 5000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                found = []
        if found:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    )
    return dealt.mapInArrow(read, schema)


def round_trip(turns: DataFrame) -> DataFrame:
    """Format, write, and read back."""
    return read_conversations(settle(format_conversations(turns)))


def with_marker_case(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts are made of markers."""
    spark = turns.sparkSession
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
