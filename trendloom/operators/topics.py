"""Topics described by class-based TF-IDF: weights, words, similarity, distribution, merging.

Term tables are long: one row per topic and term. Counts are additive, so topics merge without
reading text again. A topic may hold a third of all terms; nothing here windows over a topic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trendloom import parcels
from trendloom.functions import text
from trendloom.operators.ranking import first_per_group, with_position
from trendloom.schemas import OUTLIER
from trendloom.session import settle

# Padding of word lists and settings of the approximate distribution.
PAD_WORD, PAD_WEIGHT = "", 0.00001
WINDOW = 4
MIN_WINDOW_SIMILARITY = 0.1
MIN_SIMILARITY = 0.15
BLOCK_CHARS = 1 << 23  # of the documents whose terms are looked up together
LEAST_CHARS = 1 << 17  # fewest, where there are as many
FREQUENT = 1 << 20  # rows of terms that every task of the topic mix has
COUNT_BYTES = 1 << 23  # of the words whose terms are counted together
CELLS = 1 << 21  # of terms and topics in one matrix
# sorted terms are stored by what they share with the one before
TERMS = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def _counted(rows: pa.Table, start: int, end: int, stop_words: Sequence[str], parts: int) -> tuple[pa.Table, np.ndarray]:
    """(topic_id, term, tf) of lines of words (topic_id, words), and the part each term goes to.

    Words are numbered in order of their letters, runs in order of their words, so terms of a length come sorted.
    """
    topics = rows["topic_id"].combine_chunks().dictionary_encode("encode")
    lists = pc.split_pattern(rows["words"].combine_chunks(), " ")
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    named = lists.flatten().dictionary_encode()
    letters = pc.sort_indices(named.dictionary)
    names = named.dictionary.take(letters)
    place = np.empty(len(names), dtype=np.int64)
    place[letters.to_numpy()] = np.arange(len(names))
    word, line = place[named.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    stops = pc.is_in(names, value_set=pa.array(list(stop_words), names.type)).to_numpy(zero_copy_only=False)
    kept = ~stops[word]
    word, line = word[kept], line[kept]
    owner = topics.indices.to_numpy().astype(np.int64)[line]
    hashes = np.fromiter((crc32(w) for w in names.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(names))
    # of each run of a size: its number, and per number its text and hash
    run, texts, mixed, found = word, names, hashes, []
    for size in range(1, end + 1):
        if size > 1:
            after = word[size - 1 :]
            held = line[: len(after)] == line[size - 1 :]
            pairs = run[: len(after)] * len(names) + after
            distinct, number = np.unique(pairs[held], return_inverse=True)
            # a run cut off by the end of its line has no number
            run = np.full(len(after), -1)
            run[held] = number
            head, tail = distinct // max(len(names), 1), distinct % max(len(names), 1)
            texts = pc.binary_join_element_wise(texts.take(pa.array(head)), names.take(pa.array(tail)), pa.scalar(" ", names.type))
            mixed = mixed[head] * np.uint64(0x9E3779B97F4A7C15) + hashes[tail]
        if size >= start:
            whole = run >= 0
            key, tf = np.unique(run[whole] * len(topics.dictionary) + owner[: len(run)][whole], return_counts=True)
            term, topic = key // len(topics.dictionary), key % len(topics.dictionary)
            table = {"topic_id": topics.dictionary.take(pa.array(topic)), "term": texts.take(pa.array(term)), "tf": pa.array(tf, pa.int64())}
            found.append((pa.table(table), ((mixed[term] ^ (mixed[term] >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)))
    return pa.concat_tables([t for t, _ in found]).combine_chunks(), np.concatenate([p for _, p in found])


def term_counts(
    docs: DataFrame, start: int = 1, end: int = 2, stop_words: Sequence[str] = text.STOP_WORDS
) -> DataFrame:
    """(topic_id, term, tf) over the documents of each topic; partial sums travel in parcels."""
    parts = parcels.parts_for(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parcels.gathered(batches, COUNT_BYTES):
            yield from parcels.sent(parcels.dealt(*_counted(rows, start, end, stop_words, parts)))

    def add(rows: pa.Table) -> pa.Table:
        sums = rows.group_by(["topic_id", "term"], use_threads=False).aggregate([("tf", "sum")])
        return sums.rename_columns({"tf_sum": "tf"}).select(["topic_id", "term", "tf"]).sort_by([("term", "ascending")])

    words = docs.select("topic_id", F.array_join(text.words(F.col("text")), " ").alias("words")).filter(F.col("words") != "")
    partial = words.mapInArrow(count, "part int, parcel binary")
    kind = docs.schema["topic_id"].dataType.simpleString()
    return parcels.meet(partial, add, f"topic_id {kind}, term string, tf bigint")


def vocabulary(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """Terms of at least ``min_df`` topics."""
    return (
        counts.groupBy("term")
        .agg(F.count("*").alias("topics"), F.sum("tf").alias("total"))
        .filter(F.col("topics") >= min_df)
    )


def c_tf_idf(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """(topic_id, term, tf, idf, weight) with weight = share of the topic's terms · ln(1 + A / f).

    A is the whole part of the mean number of terms per topic, f the total of the term.
    """
    kinds = {c: counts.schema[c].dataType.simpleString() for c in ("topic_id", "tf")}

    def totals(rows: pa.Table) -> pa.Table:
        term = rows["term"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        rows = rows.append_column("_f", pa.array(np.bincount(term, weights=pc.fill_null(rows["tf"], 0).to_numpy())[term]))
        return rows.filter(pa.array(np.bincount(term)[term] >= min_df))

    # all rows of a term meet in one part
    terms = parcels.deal(counts.select("topic_id", "term", "tf"), ["term"], parcels.parts_for(counts.sparkSession))
    # settled: the sizes of the topics and the weights are both made of it
    kept = settle(parcels.meet(terms, totals, f"topic_id {kinds['topic_id']}, term string, tf {kinds['tf']}, _f double"), **TERMS)
    # a row per topic, settled so that Spark knows it is small and leaves the terms where they are
    sizes = settle(kept.groupBy("topic_id").agg(F.sum("tf").alias("_size")))
    mean = sizes.select(F.floor(F.avg("_size")).alias("a")).first()["a"] or 0
    idf = F.log1p(F.lit(float(mean)) / F.col("_f"))
    return (
        kept.join(sizes, "topic_id")
        .withColumn("idf", idf)
        .withColumn("weight", F.col("tf") / F.col("_size") * F.col("idf"))
        .select("topic_id", "term", "tf", "idf", "weight")
    )


def top_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms of each topic, one row each, with ``rank`` from 1."""
    window = Window.partitionBy("topic_id").orderBy(F.desc("weight"), F.asc("term"))
    ranked = weights.select("topic_id", "term", "weight").withColumn(
        "rank", F.row_number().over(window)
    )
    return ranked.filter(F.col("rank") <= n)


def word_lists(top: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, words, weights): lists of ``n``, padded where a topic has fewer terms."""
    entry = F.struct("rank", "term", "weight")
    lists = top.groupBy("topic_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))

    def padded(values: Column, filler: Column) -> Column:
        return F.concat(values, F.array_repeat(filler, F.lit(n) - F.size(values)))

    return lists.select(
        "topic_id",
        padded(F.transform("_e", lambda e: e["term"]), F.lit(PAD_WORD)).alias("words"),
        padded(F.transform("_e", lambda e: e["weight"]), F.lit(PAD_WEIGHT)).alias("weights"),
    )


def topic_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("topic_id").agg(F.count("*").alias("size"))


def topic_info(docs: DataFrame, weights: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, name, size, words) of each topic; a topic without terms has an empty list."""
    lists = word_lists(top_words(weights, n), n).select("topic_id", "words")
    sized = topic_sizes(docs).join(lists, "topic_id", "left")
    none = F.array_repeat(F.lit(PAD_WORD), n)
    words = F.coalesce("words", none)
    return sized.select(
        "topic_id", text.topic_name(F.col("topic_id"), words).alias("name"), "size", words.alias("words")
    )


def rank_topics_by_size(sizes: DataFrame) -> DataFrame:
    """(topic_id, new_id): topics numbered 0, 1, … by falling size; the outlier topic keeps -1."""
    proper = sizes.filter(F.col("topic_id") != OUTLIER).select("topic_id", "size")
    ranked = with_position(proper, [F.desc("size"), F.asc("topic_id")], "new_id")
    outliers = sizes.filter(F.col("topic_id") == OUTLIER).select(
        "topic_id", "size", F.lit(OUTLIER).cast("bigint").alias("new_id")
    )
    return ranked.unionByName(outliers).select("topic_id", "new_id")


def _lengths(weights: DataFrame) -> DataFrame:
    """(topic_id, _length) of each topic's vector; settled, so that Spark knows it is small."""
    return settle(weights.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_length")))


def _unit(weights: DataFrame) -> DataFrame:
    """Weights scaled so that each topic's vector has length one, outlier topic left out."""
    proper = weights.filter(F.col("topic_id") != OUTLIER)
    lengths = _lengths(proper)
    return proper.join(lengths, "topic_id").withColumn("unit", F.col("weight") / F.col("_length")).drop("_length")


def _products(rows: pa.Table) -> pa.Table:
    """Products of topic pairs summed over the terms of ``rows``, as matrix products of some terms each."""
    term = rows["term"].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    shared = np.nonzero(np.bincount(term)[term] > 1)[0]
    shared = shared[np.argsort(term[shared], kind="stable")]
    _, term = np.unique(term[shared], return_inverse=True)
    topics, column = np.unique(rows["topic_id"].to_numpy()[shared], return_inverse=True)
    unit = rows["unit"].to_numpy()[shared]
    gram = np.zeros((len(topics), len(topics)))
    step = max(1, CELLS // max(len(topics), 1))
    for low in range(0, term[-1] + 1 if len(term) else 0, step):
        a, b = np.searchsorted(term, [low, low + step])
        block = np.zeros((term[b - 1] - low + 1, len(topics)))
        block[term[a:b] - low, column[a:b]] = unit[a:b]
        gram += block.T @ block
    a, b = np.nonzero(np.triu(gram, 1))
    pairs = {"topic_a": topics[a], "topic_b": topics[b]}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in pairs.items()} | {"product": pa.array(gram[a, b], pa.float64())})


def topic_similarity(weights: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity), a < b: cosine of topics that share a term, others have 0.

    Each part of the terms yields at most one row per topic pair instead of one per term and pair.
    """
    unit = _unit(weights).select(F.col("topic_id").cast("bigint").alias("topic_id"), "term", "unit")
    terms = parcels.deal(unit, ["term"], parcels.parts_for(weights.sparkSession))
    products = parcels.meet(terms, _products, "topic_a bigint, topic_b bigint, product double")
    return products.groupBy("topic_a", "topic_b").agg(F.sum("product").alias("similarity"))


def topic_barchart_data(
    docs: DataFrame, weights: DataFrame, n_topics: int = 8, n_words: int = 5
) -> DataFrame:
    """The heaviest words of the largest topics."""
    largest = (
        topic_sizes(docs.filter(F.col("topic_id") != OUTLIER))
        .orderBy(F.desc("size"), F.asc("topic_id"))
        .limit(n_topics)
    )
    # settled, so that Spark knows it is small
    return top_words(weights.join(settle(largest), "topic_id", "left_semi"), n_words)


def merge_map(sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """(topic_id, new_id) after merging: ``groups`` (group_id, topics) lists topics that become one.

    Untouched topics stay; all are numbered anew by size.
    """
    member = groups.select("group_id", F.explode("topics").alias("topic_id"))
    lead = member.groupBy("group_id").agg(F.min("topic_id").alias("_lead"))
    target = member.join(lead, "group_id").select("topic_id", "_lead")
    # several groups may name a topic; it goes with the first
    target = target.groupBy("topic_id").agg(F.min("_lead").alias("_lead"))
    merged = sizes.join(target, "topic_id", "left").select(
        "topic_id", F.coalesce("_lead", "topic_id").alias("_lead"), "size"
    )
    summed = merged.groupBy(F.col("_lead").alias("topic_id")).agg(F.sum("size").alias("size"))
    ranks = rank_topics_by_size(summed).withColumnRenamed("topic_id", "_lead")
    return merged.join(ranks, "_lead").select("topic_id", "new_id")


def merge_topics(frame: DataFrame, mapping: DataFrame) -> DataFrame:
    """Renumber the topics of assignments or documents."""
    return frame.join(mapping, "topic_id").select(
        *(F.col("new_id").alias("topic_id") if c == "topic_id" else c for c in frame.columns)
    )


def merge_counts(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Term counts of merged topics: sums of the old counts."""
    return merge_topics(counts, mapping).groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"))


def explode_topics(groups: DataFrame) -> DataFrame:
    """(group_id, topic_id, listed): members of topic lists, with the number of lists naming each."""
    member = groups.select("group_id", F.explode("topics").alias("topic_id"))
    counts = member.groupBy("topic_id").agg(F.count("*").alias("listed"))
    return member.join(counts, "topic_id").select("group_id", "topic_id", "listed")


def max_cluster_distance(tree: DataFrame, distance: float) -> DataFrame:
    return tree.filter(F.col("distance") < distance)


def maximal_merges(tree: DataFrame, distance: float) -> DataFrame:
    """Rows of a merge tree below a distance that no other such row contains."""
    close = max_cluster_distance(tree, distance)
    inner = close.select(F.explode(F.array("left_id", "right_id")).alias("parent_id"))
    return close.join(inner, "parent_id", "left_anti").select(*tree.columns)


def _in_blocks(docs: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(keys, block, doc_id, words) with words joined by spaces, and the columns that name a block.

    A block holds the documents of about ``BLOCK_CHARS`` (of one group by ``keys``) and lies in one
    task. Terms repeat within a block, so looking them up once per block moves far fewer rows
    than once per occurrence.
    """
    spark = docs.sparkSession
    worded = settle(
        docs.select(*keys, "doc_id", F.array_join(text.words(F.col("text")), " ").alias("words")).filter(F.col("words") != ""),
        compression="zstd",
    )
    # a row per group
    sizes = worded.groupBy(*keys).agg(F.sum(F.length("words")).alias("_chars"))
    total = sizes.agg(F.sum("_chars")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_CHARS))
    most = min(BLOCK_CHARS, max(total // tasks, LEAST_CHARS))  # small tables keep all tasks busy
    parts = F.ceil(F.col("_chars") / most)
    if keys:
        worded = worded.join(sizes.select(*keys, parts.alias("_parts")), list(keys))
    else:
        worded = worded.withColumn("_parts", F.lit(max(-(-total // most), 1)))
    block = F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("bigint").alias("block")
    names = [*keys, "block"]
    return worded.select(*keys, block, "doc_id", "words").repartition(tasks, *names), names


def _block_terms(
    blocks: DataFrame, names: Sequence[str], window: int | None, start: int, end: int, stop_words: Sequence[str]
) -> DataFrame:
    """(names, term): the distinct terms of each block in order, found where the block lies."""

    def distinct(rows: pa.Table) -> pa.Table:
        term = _occurred(rows, window, start, end, stop_words)[5].unique()
        named = {c: pa.array([rows[c][0].as_py()] * len(term), rows.schema.field(c).type) for c in names}
        return pa.table(named | {"term": term.take(pc.sort_indices(term))})

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in names)
    return blocks.groupBy(*names).applyInArrow(distinct, f"{kinds}, term string")


def _occurred(
    rows: pa.Table, window: int | None, start: int, end: int, stop_words: Sequence[str]
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The terms of a block: documents, words of each, and per term its document, first and last word and text.

    Rows with one doc_id are one document.
    """
    ids = rows["doc_id"].combine_chunks().dictionary_encode("encode")
    owner = ids.indices.to_numpy()
    lists = pc.split_pattern(rows["words"].combine_chunks(), " ")
    sizes = pc.list_value_length(lists).to_numpy()
    n = np.zeros(len(ids.dictionary), dtype=np.int64)
    np.maximum.at(n, owner, sizes)
    words = lists.flatten()
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stops = pc.is_in(words, value_set=pa.array(list(stop_words), words.type))
    kept = np.nonzero(~stops.to_numpy(zero_copy_only=False))[0]
    line, place, words = line[kept], place[kept], words.take(pa.array(kept))
    found = []
    for size in range(start, end + 1):
        first = np.arange(max(len(kept) - size + 1, 0))
        last = first + size - 1
        held = line[first] == line[last]
        if size > 1 and window is not None:
            held &= place[last] - place[first] < window
        first, last = first[held], last[held]
        parts = [words.take(pa.array(first + i)) for i in range(size)]
        term = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", words.type))
        found.append((owner[line[first]], place[first], place[last], term))
    return ids.dictionary, n, *(np.concatenate(x) for x in list(zip(*found))[:3]), pa.concat_arrays([f[3] for f in found])


def _rows_of(term: pa.Array, known: pa.Table) -> np.ndarray:
    """The row in ``known`` (term) of each term, -1 for others."""
    row = pc.index_in(term, value_set=known["term"].combine_chunks().cast(term.type))
    return pc.fill_null(row, -1).to_numpy().astype(np.int64)


def _found_terms(
    rows: pa.Table, known: pa.Table, window: int | None, start: int, end: int, stop_words: Sequence[str]
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a block that ``known`` (term) holds, in order of document and first word:
    documents, words of each, and per term its document, first word, last word and row in ``known``.
    """
    ids, n, doc, p, q, term = _occurred(rows, window, start, end, stop_words)
    row = _rows_of(term, known)
    held = np.nonzero(row >= 0)[0]
    held = held[np.lexsort((p[held], doc[held]))]
    return ids, n, doc[held], p[held], q[held], row[held]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] … starts[i] + sizes[i] - 1 of all i, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _run_sums(
    p: np.ndarray, q: np.ndarray, term: np.ndarray, idf: np.ndarray, sizes: np.ndarray,
    column: np.ndarray, share: np.ndarray, worth: np.ndarray, topics: int, window: int, least: float,
) -> np.ndarray:
    """Similarities of the runs of a document worth a look to each topic, summed from ``least`` on.

    Runs are taken in slices, so a long document needs no more memory than a short one.
    """
    total, runs = np.zeros(topics), len(worth)
    weight = np.zeros(term.max() + 1)
    weight[term] = idf
    step = max(1, (1 << 21) // topics)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for low in range(0, runs, step):
        high = min(low + step, runs)
        # rows are in order of p; a run from r holds terms that begin at r … r + window - 1
        a, b = np.searchsorted(p, [low, high + window - 1])
        part, flat = slice(a, b), slice(ends[a], ends[b])
        dots = np.zeros((high - low) * topics)
        keys = []
        for back in range(window):
            r = p[part] - back
            held = (r >= low) & (r < high) & (q[part] - r < window)
            spread = np.repeat(held, sizes[part])
            cell = (np.repeat(r, sizes[part])[spread] - low) * topics + column[flat][spread]
            dots += np.bincount(cell, weights=share[flat][spread], minlength=len(dots))
            keys.append((r[held] - low).astype(np.int64) * len(weight) + term[part][held])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        run, word = key // len(weight), key % len(weight)
        length = np.sqrt(np.bincount(run, weights=(weight[word] * count) ** 2, minlength=high - low))
        seen = worth[low:high] & (length > 0)
        similar = dots.reshape(high - low, topics)[seen] / length[seen, None]
        total += np.where(similar >= least, similar, 0).sum(axis=0)
    return total


def _frequent_terms(units: DataFrame, strong: float) -> tuple[pa.Table, float]:
    """(term, idf, most) of the terms that are common or weigh much in a topic, ``most`` the largest
    unit weight of each; and a bound on the unit weights of all other terms.

    About ``FREQUENT`` rows of ``units`` (topic_id, term, idf, unit) of either kind are taken, so that they fit a task.
    """
    steps = [strong / q for q in (1, 4, 16)]
    level = sum((F.coalesce(F.col("unit"), F.lit(0.0)) >= x).cast("int") for x in steps)
    bins = units.groupBy(F.floor(F.col("idf") * 16).alias("bin"), level.alias("level")).agg(F.count("*").alias("n"))
    # a few hundred bins
    counts = [(r["bin"], r["level"], r["n"]) for r in bins.filter(F.col("bin").isNotNull()).collect()]
    heavy = [sum(n for _, held, n in counts if held > i) for i in range(len(steps))]
    bound = min((x for x, n in zip(steps, heavy) if n <= FREQUENT), default=None)
    last, rows = None, 0
    for low in sorted({b for b, _, _ in counts}):
        rows += sum(n for b, _, n in counts if b == low)
        if rows > FREQUENT:
            break
        last = low
    wanted = F.lit(False)
    if bound is not None:
        wanted |= F.col("unit") >= bound
    if last is not None:
        wanted |= F.floor(F.col("idf") * 16) <= last
    taken = units.filter(wanted).groupBy("term").agg(
        F.first("idf").alias("idf"), F.coalesce(F.max("unit"), F.lit(0.0)).alias("most")
    )
    # a unit weight is 1 at most
    return taken.toArrow(), 1.0 if bound is None else bound


def _worth_a_look(
    n: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, row: np.ndarray, frequent: pa.Table, bound: float,
    window: int, least: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which runs of the documents may reach ``least`` for a topic, where the runs of each document
    begin, and which terms lie in such a run.

    With x the part of a term in a run and u its unit weight, the similarity is the sum of x u by the length of x. Frequent
    terms give no more than the sum of x · most by the length of their own x, the m others no more than bound · √m.
    """
    runs = np.maximum(n - window + 1, 1)
    starts = np.cumsum(runs) - runs
    total = int(runs.sum())
    # the first and last run of the document that hold a term
    low, high = starts[doc] + np.maximum(q - window + 1, 0), starts[doc] + np.minimum(p, runs[doc] - 1)
    common = row >= 0
    idf, most = (frequent[c].to_numpy()[row[common]] for c in ("idf", "most"))

    def summed(which: np.ndarray, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(total)
        for step in range(window):
            at = low[which] + step
            held = at <= high[which]
            sums += np.bincount(at[held], weights=values[held], minlength=total)
        return sums

    square, dot = summed(common, idf**2), summed(common, idf * most)
    others = summed(~common, np.ones(int((~common).sum())))
    best = np.divide(dot, np.sqrt(square), out=np.zeros(total), where=square > 0) + bound * np.sqrt(others)
    # the margin covers rounding
    worth = best >= least * (1 - 1e-9)
    before = np.concatenate([[0], np.cumsum(worth)])
    return worth, starts, before[np.maximum(high, low - 1) + 1] > before[low]


def _mixer(
    window: int, least: float, strong: float, start: int, end: int, stop_words: Sequence[str], frequent: pa.Table, bound: float,
    kind: pa.DataType,
):
    """For the documents of one block and its terms with their topics: the mix of each document."""

    def mix(rows: pa.Table, parcel: pa.Table) -> pa.Table:
        if not parcel.num_rows:
            return pa.table({"doc_id": rows["doc_id"].slice(0, 0), "topic_id": pa.array([], kind), "probability": pa.array([], pa.float64())})
        known = parcels.unpacked(parcel["parcel"].to_pylist())
        ids, n, doc, p, q, term = _occurred(rows, window, start, end, stop_words)
        worth, begin, held = _worth_a_look(n, doc, p, q, _rows_of(term, frequent), frequent, bound, window, least)
        doc, p, q, term = doc[held], p[held], q[held], term.filter(pa.array(held))
        term = _rows_of(term, known)
        order = np.nonzero(term >= 0)[0]
        order = order[np.lexsort((p[order], doc[order]))]
        doc, p, q, term = doc[order], p[order], q[order], term[order]
        lists, values = known["topics"].combine_chunks(), known["units"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        starts, unit, idf = np.cumsum(sizes) - sizes, values.flatten().to_numpy(), known["idf"].to_numpy()
        names, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        docs, topics, shares = [], [], []
        edges = np.nonzero(np.diff(doc, prepend=-1))[0]
        for low, high in zip(edges, np.append(edges[1:], len(doc))):
            held, mine = np.unique(term[low:high], return_inverse=True)
            cells = _ranges(starts[held], sizes[held])
            candidates = np.unique(column[cells][unit[cells] >= strong])
            if not len(candidates):
                continue
            at = np.minimum(np.searchsorted(candidates, column[cells]), len(candidates) - 1)
            taken = candidates[at] == column[cells]
            owner = np.repeat(np.arange(len(held)), sizes[held])[taken]
            own = np.bincount(owner, minlength=len(held))
            spread = _ranges((np.cumsum(own) - own)[mine], own[mine])
            weight = idf[held][mine]
            share = _run_sums(
                p[low:high], q[low:high], mine, weight, own[mine], at[taken][spread],
                np.repeat(weight, own[mine]) * unit[cells][taken][spread],
                worth[begin[doc[low]] :][: max(int(n[doc[low]]) - window + 1, 1)], len(candidates), window, least,
            )
            kept = np.nonzero(share)[0]
            docs.append(np.full(len(kept), doc[low]))
            topics.append(candidates[kept])
            shares.append(share[kept] / share.sum() if len(kept) else share[kept])
        chosen = [np.concatenate(x) if x else np.zeros(0, dtype=kind) for x, kind in ((docs, int), (topics, int), (shares, float))]
        return pa.table(
            {
                "doc_id": ids.take(pa.array(chosen[0])),
                "topic_id": pa.array(names[chosen[1]], lists.type.value_type),
                "probability": pa.array(chosen[2], pa.float64()),
            }
        )

    return mix


def _answers(wanted: pa.Table, held: pa.Table) -> pa.Table:
    """(block, parcel): of the terms that each block asks for, (term, idf, topics, units) of those that are held."""
    nothing = pa.table({"block": pa.array([], pa.int64()), "parcel": pa.array([], pa.binary())})
    if not wanted.num_rows or not held.num_rows:
        return nothing
    wanted, held = (parcels.unpacked(x["parcel"].to_pylist()) for x in (wanted, held))
    terms = wanted["term"].combine_chunks().unique()
    row = _rows_of(held["term"].combine_chunks(), pa.table({"term": terms}))
    order = np.nonzero(row >= 0)[0]
    order = order[np.argsort(row[order], kind="stable")]
    row, held = row[order], held.take(pa.array(order))
    known, first = np.unique(row, return_index=True)
    # a term that only outliers hold has no entries
    entry = held["unit"].is_valid().to_numpy()
    counts = np.bincount(row[entry], minlength=len(terms))[known]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = {
        c: pa.ListArray.from_arrays(offsets, held[v].filter(pa.array(entry)).combine_chunks()) for c, v in (("topics", "topic_id"), ("units", "unit"))
    }
    place = np.full(len(terms), -1)
    place[known] = np.arange(len(known))
    at = place[_rows_of(wanted["term"].combine_chunks(), pa.table({"term": terms}))]
    found = np.nonzero(at >= 0)[0]
    block, at = wanted["block"].to_numpy()[found], at[found]
    answer = pa.table({"term": terms.take(pa.array(known)), "idf": held["idf"].take(pa.array(first)), **lists})
    blocks, number = np.unique(block, return_inverse=True)
    sent = [(int(blocks[i]), parcels.packed(answer.take(rows["at"].combine_chunks()))) for i, rows in parcels.dealt(pa.table({"at": at}), number)]
    return pa.table({"block": pa.array([b for b, _ in sent], pa.int64()), "parcel": pa.array([x for _, x in sent], pa.binary())})


def approximate_distribution(
    docs: DataFrame,
    weights: DataFrame,
    window: int = WINDOW,
    min_window_similarity: float = MIN_WINDOW_SIMILARITY,
    start: int = 1,
    end: int = 2,
    stop_words: Sequence[str] = text.STOP_WORDS,
) -> DataFrame:
    """(doc_id, topic_id, probability): the mix of topics in each document, adding up to 1.

    Every run of ``window`` words is compared with every topic by cosine; similarities below the
    minimum count as 0, the others are summed per topic. Exact, yet not every document meets every
    topic: a run of at most m terms reaches the minimum only if it holds a term of weight
    min / √m or more in the topic's unit vector, and a topic has at most m / min² such terms.
    These strong terms choose the topics for which a document is worked out.

    Documents are dealt into blocks. Every task has the frequent terms; they rule out most runs (``_worth_a_look``). The
    terms of the others are looked up once per block, both sides in parcels; a task then adds up the runs of the
    documents of a block, one document after the other.
    """
    most = sum(max(window - n + 1, 0) for n in range(start, end + 1))
    # the margin covers rounding
    strong = min_window_similarity / most**0.5 * (1 - 1e-9)
    lengths = _lengths(weights.filter(F.col("topic_id") != OUTLIER))
    # a term that only outliers hold has no unit weight, yet counts in the length of a run
    units = weights.join(lengths, "topic_id", "left").select(
        "topic_id", "term", "idf", (F.col("weight") / F.col("_length")).alias("unit")
    )
    frequent, bound = _frequent_terms(units, strong)

    # rows without a key have no document to belong to
    blocks, names = _in_blocks(docs.filter(F.col("doc_id").isNotNull()))

    def asked(rows: pa.Table) -> pa.Table:
        _, n, doc, p, q, term = _occurred(rows, window, start, end, stop_words)
        row = _rows_of(term, frequent)
        held = _worth_a_look(n, doc, p, q, row, frequent, bound, window, min_window_similarity)[2]
        term = term.filter(pa.array(held)).unique()
        return pa.table({"block": pa.array(np.full(len(term), rows["block"][0].as_py()), pa.int64()), "term": term.take(pc.sort_indices(term))})

    parts = parcels.parts_for(docs.sparkSession)
    wanted = parcels.deal(blocks.groupBy(*names).applyInArrow(asked, "block bigint, term string"), ["term"], parts)
    held = parcels.deal(units, ["term"], parts)
    answers = wanted.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(_answers, "block bigint, parcel binary")
    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("doc_id", docs), ("topic_id", weights))}
    mix = _mixer(
        window, min_window_similarity, strong, start, end, stop_words, frequent, bound,
        to_arrow_type(weights.schema["topic_id"].dataType),
    )
    return blocks.groupBy(*names).cogroup(answers.groupBy(*names)).applyInArrow(
        mix, f"doc_id {kinds['doc_id']}, topic_id {kinds['topic_id']}, probability double"
    )


def min_similarity(distribution: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    return distribution.filter(F.col("probability") > least)


def reduce_outliers(docs: DataFrame, distribution: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, topic_id): outliers move to their likeliest topic if it reaches the threshold."""
    best = distribution.groupBy("doc_id").agg(
        F.max_by("topic_id", F.struct("probability", -F.col("topic_id"))).alias("_best"),
        F.max("probability").alias("_probability"),
    )
    moves = (F.col("topic_id") == OUTLIER) & (F.col("_probability") >= threshold)
    return docs.select("doc_id", "topic_id").join(best, "doc_id", "left").select(
        "doc_id", F.when(moves, F.col("_best")).otherwise(F.col("topic_id")).alias("topic_id")
    )


def unpivot_distribution(wide: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, topic_id, probability) from one column per topic, the columns named by topic id."""
    topics = [c for c in wide.columns if c != key]
    return wide.unpivot(key, topics, "topic_id", "probability").withColumn(
        "topic_id", F.col("topic_id").cast("int")
    )


def representative_documents(
    docs: DataFrame,
    weights: DataFrame,
    n: int = 5,
    start: int = 1,
    end: int = 2,
    stop_words: Sequence[str] = text.STOP_WORDS,
) -> DataFrame:
    """(topic_id, doc_id, similarity): the ``n`` documents of each topic closest to its terms.

    Terms are looked up once per block of documents of a topic, both sides in parcels.
    """
    blocks, names = _in_blocks(docs.filter(F.col("topic_id").isNotNull()), ["topic_id"])
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "topic_id")}
    topic_kind = to_arrow_type(docs.schema["topic_id"].dataType)

    def answers(wanted: pa.Table, held: pa.Table) -> pa.Table:
        """Of the terms that each block asks for, (term, idf, weight) of those its topic holds."""
        sent = []
        if wanted.num_rows and held.num_rows:
            wanted, held = (parcels.unpacked(x["parcel"].to_pylist()) for x in (wanted, held))
            found = wanted.join(held, ["topic_id", "term"], join_type="inner", use_threads=False).sort_by([("term", "ascending")]).combine_chunks()
            topic = found["topic_id"].combine_chunks().dictionary_encode()
            # blocks of a topic are numbered from 0
            width = (pc.max(found["block"]).as_py() or 0) + 1
            number = topic.indices.to_numpy().astype(np.int64) * width + found["block"].to_numpy()
            rows = found.select(["term", "idf", "weight"])
            sent = [(topic.dictionary[i // width].as_py(), i % width, parcels.packed(x)) for i, x in parcels.dealt(rows, number)]
        types = {"topic_id": topic_kind, "block": pa.int64(), "parcel": pa.binary()}
        return pa.table({c: pa.array([x[i] for x in sent], t) for i, (c, t) in enumerate(types.items())})

    # terms of a topic meet in one part, both sides in parcels
    parts = parcels.parts_for(docs.sparkSession)
    wanted = _block_terms(blocks, names, None, start, end, stop_words)
    held = weights.select(F.col("topic_id").cast(kinds["topic_id"]).alias("topic_id"), "term", "idf", "weight")
    known = (
        parcels.deal(wanted, ["topic_id", "term"], parts).groupBy("part")
        .cogroup(parcels.deal(held, ["topic_id", "term"], parts).groupBy("part"))
        .applyInArrow(answers, f"topic_id {kinds['topic_id']}, block bigint, parcel binary")
    )

    def products(rows: pa.Table, parcel: pa.Table) -> pa.Table:
        if not parcel.num_rows:
            return pa.table({"topic_id": pa.array([], topic_kind), "doc_id": rows["doc_id"].slice(0, 0), "_dot": pa.array([], pa.float64())})
        terms = parcels.unpacked(parcel["parcel"].to_pylist())
        ids, _, doc, _, _, term = _found_terms(rows, terms, None, start, end, stop_words)
        idf, weight = terms["idf"].to_numpy(), terms["weight"].to_numpy()
        key, count = np.unique(doc.astype(np.int64) * max(len(idf), 1) + term, return_counts=True)
        doc, term = key // max(len(idf), 1), key % max(len(idf), 1)
        x = count * idf[term]
        dot, length = (np.bincount(doc, weights=v, minlength=len(ids)) for v in (x * weight[term], x**2))
        kept = np.unique(doc)
        topic = rows["topic_id"].slice(0, 1).to_pylist() * len(kept)
        return pa.table(
            {
                "topic_id": pa.array(topic, rows.schema.field("topic_id").type),
                "doc_id": ids.take(pa.array(kept)),
                "_dot": pa.array(dot[kept] / np.sqrt(length[kept]), pa.float64()),
            }
        )

    dots = blocks.groupBy(*names).cogroup(known.groupBy(*names)).applyInArrow(
        products, f"topic_id {kinds['topic_id']}, doc_id {kinds['doc_id']}, _dot double"
    )
    lengths = _lengths(weights)
    # rounded, so that copies tie whatever the order of their sums
    scored = dots.join(lengths, "topic_id").select(
        "topic_id", "doc_id", F.round(F.col("_dot") / F.col("_length"), 9).alias("similarity")
    )
    return first_per_group(scored, ["topic_id"], [F.desc("similarity"), F.asc("doc_id")], n)


def label_documents(
    docs: DataFrame, weights: DataFrame, prompt: str, n: int = 5, n_words: int = 10
) -> DataFrame:
    """(topic_id, prompt): the prompt with [DOCUMENTS] and [KEYWORDS] filled in per topic."""
    # a few rows per topic, settled so that the texts stay where they are
    closest = settle(representative_documents(docs, weights, n)).join(docs.select("doc_id", "text"), "doc_id")
    order = F.struct((-F.col("similarity")).alias("s"), "doc_id", "text")
    texts = closest.groupBy("topic_id").agg(F.array_sort(F.collect_list(order)).alias("_d"))
    listing = F.array_join(F.transform("_d", lambda d: F.concat(F.lit("- "), d["text"], F.lit("\n"))), "")
    words = word_lists(top_words(weights, n_words), n_words)
    keywords = F.array_join(F.filter("words", lambda w: w != PAD_WORD), ", ")
    filled = F.replace(
        F.replace(F.lit(prompt), F.lit("[KEYWORDS]"), keywords), F.lit("[DOCUMENTS]"), listing
    )
    return texts.join(words, "topic_id").select("topic_id", filled.alias("prompt"))


def _diverse(rows: pd.DataFrame, n: int, diversity: float) -> pd.DataFrame:
    """Pick words one by one: close to the topic, unlike the words picked before."""
    rows = rows.sort_values("rank", ignore_index=True)
    topic = rows["topic_id"].iloc[0]
    names = np.unique(np.concatenate(rows["topics"].to_list()))
    profiles = np.zeros((len(rows), len(names)))
    for i, (topics, values) in enumerate(zip(rows["topics"], rows["values"])):
        profiles[i, np.searchsorted(names, topics)] = values
    profiles /= np.linalg.norm(profiles, axis=1, keepdims=True)
    relevance = profiles[:, np.searchsorted(names, topic)]
    alike = profiles @ profiles.T
    picked = [int(np.argmax(relevance))]
    while len(picked) < min(n, len(rows)):
        score = (1 - diversity) * relevance - diversity * alike[:, picked].max(axis=1)
        score[picked] = -np.inf
        picked.append(int(np.argmax(score)))
    chosen = rows.loc[picked, ["topic_id", "term", "weight"]]
    return chosen.assign(rank=np.arange(1, len(picked) + 1))


def mmr_keywords(
    weights: DataFrame, n: int = 10, diversity: float = 0.32, candidates: int = 30
) -> DataFrame:
    """(topic_id, term, weight, rank): top words of each topic re-ranked for relevance and variety.

    A word stands for its weights over all topics. A group holds one topic's candidates.
    """
    # a few rows per topic, settled so that the weights stay where they are
    top = settle(top_words(weights, candidates))
    profile = (
        weights.join(top.select("term"), "term", "left_semi")
        .groupBy("term")
        .agg(F.collect_list("topic_id").alias("topics"), F.collect_list("weight").alias("values"))
    )
    kind = weights.schema["topic_id"].dataType.simpleString()
    return (
        top.join(profile, "term")
        .groupBy("topic_id")
        .applyInPandas(
            lambda rows: _diverse(rows, n, diversity),
            f"topic_id {kind}, term string, weight double, rank int",
        )
    )
