"""Phrase collocation mining by marginalising the longest windows.

Texts are cut into pieces at marks and line ends, pieces into words. Every word starts one window:
its own word and the following ones of the piece, ``LONGEST`` columns in all, padded with nulls at
the end of the piece. Only these longest windows are counted. A phrase of fewer words occurs once
for each window it leads, so ROLLUP over the columns sums its occurrences from the counts of the
windows, and the sum over all windows of a language is its number of words.

Most windows of a large corpus are unique and would be shuffled for nothing: a phrase can only reach
``least`` occurrences if all its parts do. Two, then three words in a row are counted by their hash
first; a window ends before the first that stay below. Which reach it, the tasks look up in Bloom
filters of at most ``FILTER_BITS`` bits. What these let through by mistake, or because so many are
frequent that they are full, only makes windows longer: the windows' counts alone decide.

Words are in lower case (A-Z only). Null texts are empty; languages that are null are ``und``;
repeated rows count each; texts of any length are read in slices. No rows give no phrases. Ties
go by score, count and phrase in the order of its bytes. Other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import text_of, tidy
from trendloom.operators.ranking import with_position
from trendloom.session import settle

LONGEST = 4  # words of a window
LEAST = 30  # occurrences of a candidate
TOP = 2000  # phrases of a language
FILTERED = (2, 3)  # words in a row that are counted by hash first
FILTER_BITS = 1 << 27  # of a broadcast filter: 16 MB
SLICE = 1 << 21  # bytes looked at together
MARKS = b".,;:!?\n\x0b\x0c\r"
# every mark becomes a full stop, which no word holds then; tabs become spaces
CLEAN = bytes.maketrans(
    string.ascii_uppercase.encode() + MARKS + b"\t",
    string.ascii_lowercase.encode() + b"." * len(MARKS) + b" ",
)
AHEAD = re.compile(rb" *(?:[^ .]+ +){0,%d}[^ .]*" % (LONGEST - 2))  # the words a last window needs
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """Cleaned text of about ``most`` bytes, and how many of its bytes may start windows; what
    follows completes windows of the last words. Texts are apart by a mark."""
    parts: list[bytes] = []
    size = 0
    for raw in texts:
        data = raw.translate(CLEAN)
        if size and size + len(data) > most:
            whole = b".".join(parts)
            yield whole, len(whole)
            parts, size = [], 0
        if len(data) <= most:
            parts.append(data)
            size += len(data) + 1
            continue
        at = 0
        while at < len(data):
            end = data.find(b" ", at + most)
            end = len(data) if end < 0 else end
            ahead = AHEAD.match(data, end)
            yield data[at : ahead.end()], end - at
            at = end
    if parts:
        whole = b".".join(parts)
        yield whole, len(whole)


def numbered(data: bytes, upto: int) -> tuple[list[bytes], np.ndarray, int]:
    """Distinct words, the number of each word in the text (0: a mark) and how many of these
    come from the first ``upto`` bytes."""
    tokens = data.replace(b".", b" . ").split()
    code = dict.fromkeys([b".", *tokens])
    code = dict(zip(code, range(len(code))))
    ids = np.fromiter(map(code.__getitem__, tokens), np.int64, len(tokens))
    counted = len(tokens) if upto == len(data) else len(data[:upto].replace(b".", b" . ").split())
    return list(code), ids, counted


def gram_hashes(lang: str, words: list[bytes], ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` words from each place on; those beyond the end count as marks."""
    from xxhash import xxh3_64_intdigest

    known = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    each = np.concatenate([known[ids], np.zeros(width, np.uint64)])
    mixed = np.full(len(ids), xxh3_64_intdigest(lang.encode()), np.uint64)
    for i in range(width):  # depends on the order of the words
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(ids)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    size = np.uint64(64 * len(words) - 1)
    found = np.ones(len(hashes), bool)
    for bit in (hashes & size, (hashes >> np.uint64(36)) & size):
        found &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def possible(
    lang: str, words: list[bytes], ids: np.ndarray, filters: dict[int, np.ndarray], width: int
) -> Iterator[np.ndarray]:
    """For 1, 2 … ``width`` words: where so many of one piece begin whose parts all pass the
    ``filters`` (by width)."""
    found = ids > 0
    yield found
    for size in range(2, width + 1):
        found = found & np.append(found[1:], False)
        if size in filters:
            at = np.flatnonzero(found)
            found[at] = in_filter(filters[size], gram_hashes(lang, words, ids, size)[at])
        yield found


def _by_lang(batch) -> Iterator[tuple[str, bytes, int]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
        texts.setdefault(lang, []).append(text.as_py())
    for lang, found in texts.items():
        for data, upto in slices(found):
            yield lang, data, upto


def gram_counts(texts: DataFrame, width: int, filters: dict[int, np.ndarray]) -> DataFrame:
    """``gram`` (hash) and ``n`` of the ``width`` words in a row that pass the ``filters``, per
    slice of text."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lang, data, upto in _by_lang(batch):
                words, ids, counted = numbered(data, upto)
                *_, found = possible(lang, words, ids, shared.value, width)
                at = np.flatnonzero(found[:counted])
                grams, n = np.unique(gram_hashes(lang, words, ids, width)[at], return_counts=True)
                yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return texts.mapInArrow(tidy(count), "gram bigint, n bigint")


def _bits(gram: Column, size: int) -> list[Column]:
    """The two places of a hash in a filter of ``size`` bits, a power of two."""
    return [gram.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(gram, 36).bitwiseAND(F.lit(size - 1))]


def bloom_filter(grams: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """64-bit words of a filter of the hashes: 16 bits each, ``most_bits`` at most."""
    size = 64
    wanted = min(16 * grams.count(), most_bits)
    while size < wanted:
        size *= 2
    each = grams.select(F.explode(F.array(*_bits(F.col("gram"), size))).alias("bit"))
    held = each.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    table = held.toArrow()  # at most a row per word of the filter
    words = np.zeros(size // 64, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


def window_counts(texts: DataFrame, filters: dict[int, np.ndarray]) -> DataFrame:
    """``lang``, ``w1`` … and ``n``: the padded longest windows of each slice of text, counted.
    Windows end before what does not pass the ``filters``."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lang, data, upto in _by_lang(batch):
                words, ids, counted = numbered(data, upto)
                at = np.flatnonzero(ids[:counted])
                padded = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
                columns = [
                    np.where(found[at], padded[at + i], 0)
                    for i, found in enumerate(possible(lang, words, ids, shared.value, LONGEST))
                ]
                rows, n = count_rows(columns, len(words))
                names = pa.array([None, *words[1:]], pa.binary()).cast(pa.string())
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(n), pa.string()),
                        *(names.take(pa.array(c[rows])) for c in columns),
                        pa.array(n),
                    ],
                    names=["lang", *WORDS, "n"],
                )

    fields = ", ".join(f"{w} string" for w in WORDS)
    return texts.mapInArrow(tidy(count), f"lang string, {fields}, n bigint")


def count_rows(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first of each of the distinct rows, and how often it occurs. ``columns``
    hold numbers below ``size``."""
    code, first, n = columns[0], np.empty(0, np.int64), np.empty(0, np.int64)
    for i, column in enumerate([*columns[1:], None]):
        values, first, which, n = np.unique(
            code, return_index=True, return_inverse=True, return_counts=True
        )
        if column is not None:
            code = which * size + column
    return first, n


def phrase_counts(
    docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", most_bits: int = FILTER_BITS
) -> DataFrame:
    """``lang``, ``size`` (words; 0 for the number of all words), ``words`` (array), ``phrase`` and
    ``a`` of all phrases of up to ``LONGEST`` words that occur ``least`` times or more."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        text_of(text).cast("binary").alias("text"),
    )
    filters: dict[int, np.ndarray] = {}
    for width in FILTERED:
        grams = gram_counts(texts, width, filters).groupBy("gram").agg(F.sum("n").alias("n"))
        frequent = settle(grams.filter(F.col("n") >= least).select("gram"))
        filters = {**filters, width: bloom_filter(frequent, most_bits)}
    windows = settle(window_counts(texts, filters).groupBy("lang", *WORDS).agg(F.sum("n").alias("n")))
    rolled = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("a"), F.grouping_id().alias("_rolled"))
    # the columns rolled up are the set bits of the grouping's number, from the right
    size = F.lit(LONGEST) - F.bit_count("_rolled").cast("int")
    words = F.slice(F.array(*WORDS), F.lit(1), F.greatest(F.col("size"), F.lit(0)))
    found = rolled.withColumn("size", size).filter("size >= 0").withColumn("words", words)
    whole = F.forall("words", lambda w: w.isNotNull())  # a padded window is no phrase of its length
    return (
        found.filter(whole & ((F.col("a") >= least) | (F.col("size") == 0)))
        .select("lang", "size", "words", F.array_join("words", " ").alias("phrase"), "a")
    )


def scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r`` and ``score`` of the phrases of two words or more,
    by their lowest-scoring cut."""
    part = counts.filter("size > 0").select("lang", "phrase", "a")
    cuts = counts.filter("size > 1").select(
        "lang", "phrase", "words", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    )
    cut = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("array_join(slice(words, 1, k), ' ')").alias("_left"),
        F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("_right"),
    )
    left = part.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l"))
    right = part.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r"))
    both = cut.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    # decimals: a product of counts may pass 64 bits
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select(
        "lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score"
    )


def absorbed(counts: DataFrame, percent: int = 80) -> DataFrame:
    """``lang`` and ``phrase`` of candidates of which ``percent`` or more of the occurrences lie
    within one longer candidate."""
    inside = F.expr(
        "array_distinct(flatten(transform(sequence(2, size - 1), s -> "
        "transform(sequence(1, size - s + 1), i -> array_join(slice(words, i, s), ' ')))))"
    )
    longer = counts.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    met = counts.filter("size > 1").join(most, ["lang", "phrase"])
    enough = F.expr(f"cast(_longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {percent}")
    return met.filter(enough).select("lang", "phrase")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = 80, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Per language the first ``top`` phrases: ``lang``, ``rank`` (from 1), ``phrase``, ``a``,
    ``l``, ``r``, ``n`` (words of the language) and ``score``, all numbers long."""
    counts = settle(phrase_counts(docs, least, text, lang))
    kept = scored(counts).join(absorbed(counts, percent), ["lang", "phrase"], "left_anti")
    # ranks from places in one order of all languages: no language is brought into one task
    placed = with_position(kept, [F.col("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")])
    starts = placed.groupBy("lang").agg(F.min("position").alias("_start"))
    totals = counts.filter("size = 0").select("lang", F.col("a").alias("n"))
    of_lang = settle(starts.join(totals, "lang"))
    ranked = placed.join(of_lang, "lang").withColumn("rank", F.col("position") - F.col("_start") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
