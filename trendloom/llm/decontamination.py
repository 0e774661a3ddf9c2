"""Benchmark decontamination by a hash set of test n-grams.

Benchmark items are cut into windows of 13 words (an item of fewer words is one window). Their
hashes, and those of their first words, travel with the plan as bitmaps of up to ``BITMAP`` bits. One
scan of the documents cuts each text into words, counts them, and hands on only the windows whose
bits are set, with their words; these are verified word by word against the items, so a bit that
other hashes share changes nothing. With very many windows the bitmaps fill up and more windows are
handed on to be verified. No text is shuffled or read again.

Results belong to a text, so rows are looked up by id and a digest of the text: repeated rows get
the same result each. Words are runs of ASCII letters and digits, in lower case, and characters
beyond ASCII; null texts have no words and neither have items with null texts; items without words
have no window; items with a null id are searched for, but not listed. Empty tables give no hits.
Only DataFrame functions are used.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import small, text_of
from trendloom.session import settle

WINDOW = 13
HEAD = 4  # words of a window that are looked up first
BITMAP = 1 << 24  # bits of the windows' bitmap: 2 MB, a constant of the plan
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; texts of one byte per character have no other letters to change."""
    changed = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(changed)


def words(text: Column) -> Column:
    """What lies between runs of other characters; only the first and last part may be empty."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``length`` and ``words`` of the distinct windows of each item."""
    cut = benchmark.select(F.col(key).alias("item_id"), words(text_of(text)).alias("w")).filter(
        F.size("w") > 0
    )
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = cut.select("item_id", "w", length.alias("length"), F.explode(starts).alias("at"))
    found = each.select("item_id", "length", F.slice("w", F.col("at"), F.col("length")).alias("words"))
    return found.distinct()


def _bitmap(windows: DataFrame, hashed: Column, most_bits: int) -> Callable[[Column], Column]:
    """A test of hashes by a bitmap with a bit set for each hash of the windows: 256 bits per
    window, ``most_bits`` (a power of two) at most, as a constant array of the plan."""
    size = 64
    wanted = min(256 * windows.count(), most_bits)
    while size < wanted:
        size *= 2
    bit = hashed.bitwiseAND(F.lit(size - 1))
    rows = windows.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
    held = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    words = [0] * (size // 64)
    for row in held.collect():  # at most a row per word of the bitmap
        words[row["word"]] = row["bits"]
    bits = F.from_json(F.lit(str(words)), "array<bigint>")

    def known(h: Column) -> Column:
        at = h.bitwiseAND(F.lit(size - 1))
        word = F.get(bits, F.shiftright(at, 6).cast("int"))
        return F.call_function("bit_get", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return known


def _window(at: Column, length: int) -> list[Column]:
    """The words of ``w`` from ``at`` (from 0) on, one by one: a slice would copy the whole array."""
    return [F.get("w", at + k) for k in range(length)]


def _looked_up(known: Callable[[Column], Column], length: int) -> Callable[[Column], Column]:
    return lambda at: known(F.xxhash64(*_window(at, length)))


def _shown(length: int) -> Callable[[Column], Column]:
    return lambda at: F.struct(
        F.lit(length).alias("length"), (at + 1).alias("at"), F.array(*_window(at, length)).alias("words")
    )


def scan(rows: DataFrame, windows: DataFrame, most_bits: int = BITMAP) -> DataFrame:
    """``doc``, ``th``, ``n_words`` and ``found``: the windows of each row that may be among
    ``windows``, as ``length``, ``at`` (from 1) and ``words``. Reads every text once."""
    empty = F.array().cast("array<struct<length:int,at:int,words:array<string>>>")
    cut = rows.select("doc", "th", words(F.col("text")).alias("w"))
    parts = []
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # <= window
    for length in lengths:
        some = windows.filter(F.col("length") == length)
        kept = F.sequence(F.lit(0), F.size("w") - length)
        for size in sorted({min(HEAD, length), length}):  # the first words rule most windows out
            heads = some.select(F.slice("words", 1, size).alias("w")).distinct()
            known = _bitmap(heads, F.xxhash64(*_window(F.lit(0), size)), most_bits)
            kept = F.filter(kept, _looked_up(known, size))
        found = F.transform(kept, _shown(length))
        parts.append(F.when(F.size("w") >= length, found).otherwise(empty))
    return cut.select(
        "doc",
        "th",
        F.size("w").cast("long").alias("n_words"),
        (F.concat(*parts) if parts else empty).alias("found"),
    )


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    most_bits: int = BITMAP,
) -> DataFrame:
    """A row per row of ``docs``: ``doc``, ``th`` (hash of the text), ``n_words``, ``n_hit``,
    ``n_items`` (long), ``items`` (array of string), ``hit`` (word positions from 1) and
    ``contaminated``: a twentieth or more of the words is hit."""
    rows = docs.select(
        F.col(key).alias("doc"), F.xxhash64(text_of(text)).alias("th"), text_of(text).alias("text")
    )
    windows = settle(item_windows(benchmark, window))
    scanned = settle(scan(rows, windows, most_bits))
    each = scanned.filter(F.size("found") > 0).select("doc", "th", F.explode("found").alias("x"))
    # word by word: the bitmap lets others through
    known = windows.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    hits = each.select("doc", "th", "x.*").join(known, "words")
    grouped = settle(
        hits.groupBy("doc", "th").agg(
            F.array_distinct(
                F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("length") - 1)))
            ).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        )
    ).withColumnsRenamed({"doc": "_doc", "th": "_th"})
    of_row = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    joined = scanned.drop("found").join(grouped, of_row, "left")
    hit = F.coalesce("hit", F.array().cast("array<int>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.size(hit).cast("long")
    return joined.select(
        "doc",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        hit.alias("hit"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with the columns of ``judge`` from ``n_words`` on; columns of the rows
    with those names are replaced."""
    added = ["n_words", "n_hit", "n_items", "items", "hit", "contaminated"]
    rows = docs.select(F.struct(*(c for c in docs.columns if c not in added)).alias("_row"), *dict.fromkeys((key, text)))
    judged = settle(judge(docs, benchmark, window, key, text)).dropDuplicates(["doc", "th"])
    of_row = F.col(key).eqNullSafe(F.col("doc")) & (F.xxhash64(text_of(text)) == F.col("th"))
    return rows.join(judged, of_row).select("_row.*", *added)


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are. Only ids are joined."""
    judged = judge(docs, benchmark, window, key, text)
    bad = settle(judged.filter("contaminated").select(F.col("doc").alias("_doc"), F.col("th").alias("_th")).distinct())
    of_row = docs[key].eqNullSafe(bad["_doc"]) & (F.xxhash64(text_of(text)) == bad["_th"])
    return docs.join(small(bad), of_row, "left_anti")


def remove_spans(judged: DataFrame, text: str = "text", kept: str = "kept_text") -> DataFrame:
    """Add the text without the hit words: the words in lower case, the rest as it was.

    Words and what lies between them alternate, so the text is put together again from both.
    """
    between = F.split(lower_ascii(text_of(text)), WORD, -1)
    found = words(text_of(text))
    parts = F.transform(
        between,
        lambda gap, i: F.when(i == 0, gap).otherwise(
            F.concat(
                F.when(F.array_contains("hit", i), F.lit("")).otherwise(F.coalesce(F.get(found, i - 1), F.lit(""))),
                gap,
            )
        ),
    )
    return judged.withColumn(kept, F.array_join(parts, ""))
