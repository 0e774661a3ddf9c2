"""Near-duplicates by MinHash with sequential Bayesian verification.

One pass over the texts makes, per document, a digest of its words, the number of its distinct
word shingles and a MinHash signature. Documents with equal words are one class from then on, so a
group of copies costs one member. Classes that agree in a band of the signature share a bucket.

Pairs within a bucket are never all listed. Shingles that no other class in any bucket has bound
the similarity a class can reach: classes that cannot reach the threshold with any member of the
bucket leave it at once. In each round every bucket compares its members with its pivots, the
members with the fewest shingles of their own first, unless both are in one component by then or
cannot reach the threshold. A pivot that has met all members leaves the bucket, and a bucket whose
members are in one component is done.

The first round has one pivot and settles buckets of copies of one text. Classes still open then
are put into finer buckets: of a class's shingles, the rarest first, only as many are kept as two
sets at the threshold must share one of, and each is a bucket. The place of a shared shingle in
that order bounds the similarity of a pair, as it is the first they share in one of their buckets.
The number of pivots grows fourfold from round to round, in rows of ``HEADS``, so every pair that
might still join two components gets compared, without a cap.

A pair is verified in steps. Sizes and shingles of their own that cannot reach the threshold fall
out first. Then the
signatures are compared in batches: after each batch, the pair is dropped if the posterior
probability (uniform prior) that its similarity reaches the threshold is below ``MISS``. Survivors
are compared on their full shingle sets, so no false link remains. With 20 bands of 4 rows, a pair
at similarity 0.85 shares no band with probability 4e-7, one at 0.8 with 2.6e-5. ``op7`` takes
three words and 85 per cent (the defaults), the corpus pipeline five words and 80 per cent.

Words are runs of characters other than ASCII white space, with A-Z in lower case; a text of fewer
than ``shingle`` words is one shingle; null texts and texts without words have none and are linked
with nothing. Repeated rows are copies of each other; an id with several texts is one document, which
links what any of its texts links. Rows with a null id get their own component null and are kept, as
nothing can be named after them. Texts of any length are read whole. Other columns are not read. No
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import small, text_of, tidy
from trendloom.llm.components import components
from trendloom.operators.ranking import first_per_group
from trendloom.session import settle

BANDS, ROWS = 20, 4
HEADS = 64  # pivots in a row
BATCH = 16  # of the signature, between two looks at the posterior
MISS = 1e-9
WANTED = 1_000_000  # most ids, and
NAMED = 250_000  # most classes (ids and digest), that are sent to all tasks; beyond, by shuffle
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MASK = (1 << 64) - 1


def shingles(text: str, width: int):
    """Sorted distinct 64-bit hashes of the word shingles, and the digest of all words."""
    import numpy as np
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64), None
    digest = xxh3_128_digest(b" ".join(words))
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64), digest
    n = len(h) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):  # depends on the order of the words
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed), digest


def hash_functions(count: int):
    """Odd factors and masks of the signature's hash functions, from a fixed seed."""
    import numpy as np

    rng = np.random.default_rng(20240229)
    factors, masks = rng.integers(0, MASK, (2, count), np.uint64, endpoint=True)
    return factors | np.uint64(1), masks


def signature(values, factors, masks):
    """The upper half of the least hash per function."""
    import numpy as np

    least = np.full(len(factors), MASK, np.uint64)
    for at in range(0, len(values), 2048):
        block = values[at : at + 2048]
        hashed = (block[None, :] ^ masks[:, None]) * factors[:, None]
        least = np.minimum(least, hashed.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``digest`` (binary, null without words), ``n`` (int) and ``signature`` (binary)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        factors, masks = hash_functions(BANDS * ROWS)
        for batch in batches:
            sizes, digests, signed = [], [], []
            for value in batch.column("text"):
                found, digest = shingles(value.as_py(), shingle)
                sizes.append(len(found))
                digests.append(digest)
                signed.append(signature(found, factors, masks).tobytes() if len(found) else None)
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(signed, pa.binary()),
                ],
                names=["id", "digest", "n", "signature"],
            )

    return rows.mapInArrow(tidy(sign), f"id {kind}, digest binary, n int, signature binary")


def buckets(classes: DataFrame) -> DataFrame:
    """``bucket`` (hash of the band and its part of the signature), ``id``: a row per band."""
    width = 4 * ROWS
    bands = F.array(
        *(F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS))
    )
    return classes.select("id", F.explode(bands).alias("bucket"))


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """Per number of compared hashes, how many must agree for the posterior to reach ``miss``.

    With a uniform prior and m of n agreeing, the similarity has the Beta(m + 1, n - m + 1)
    distribution, whose upper tail is a binomial sum.
    """
    from math import comb

    needed = {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:  # P(S >= t | m, n) = P(Binomial(n + 1, t) <= m)
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed[n] = m
    return needed


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` that sizes, shingles of their own and posterior leave."""
    needed = least_matches(percent / 100, MISS)
    kind = classes.schema["id"].dataType.simpleString()
    left, right = (
        classes.select(
            F.col("id").alias(x),
            F.col("n").alias(f"n_{x}"),
            (F.col("n") - F.col("own")).alias(f"c_{x}"),
            F.col("signature").alias(f"s_{x}"),
        )
        for x in "ab"
    )
    sized = pairs.join(left, "a").join(right, "b")
    most = F.least("c_a", "c_b")  # no more shingles than these can be common
    fits = most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(
                    batch.num_rows, -1
                )
                for c in ("s_a", "s_b")
            )
            open_rows = np.arange(batch.num_rows)
            agree = np.zeros(batch.num_rows, np.int32)
            for upto, least in needed.items():
                part = slice(upto - BATCH, upto)
                agree[open_rows] += (a[open_rows, part] == b[open_rows, part]).sum(axis=1)
                open_rows = open_rows[agree[open_rows] >= least]
            yield batch.select(["a", "b"]).take(pa.array(open_rows))

    kept = sized.filter(fits).select("a", "b", "s_a", "s_b")
    return kept.mapInArrow(tidy(compare), f"a {kind}, b {kind}")


def shingle_sets(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """``id``, ``digest`` and ``values``: the full sets, as sorted arrays of 64-bit hashes."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(x.as_py(), shingle) for x in part.column("text")]
                columns = [
                    part.column("id"),
                    pa.array([digest for _, digest in found], pa.binary()),
                    pa.array([v.view(np.int64) for v, _ in found], pa.list_(pa.int64())),
                ]
                yield pa.record_batch(columns, names=["id", "digest", "values"])

    return rows.mapInArrow(tidy(cut), f"id {kind}, digest binary, values array<bigint>")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("id").alias(x), F.col("values").alias(f"v_{x}")) for x in "ab")
    both = F.size(F.array_intersect("v_a", "v_b"))
    joined = pairs.join(left, "a").join(right, "b")
    union = F.size("v_a") + F.size("v_b") - both
    return joined.filter(both * 100 >= union * percent).select("a", "b")


def own_shingles(sets: DataFrame) -> DataFrame:
    """``id`` and ``own``: how many of its shingles no other class has, where there are any."""
    each = sets.select("id", F.explode("values").alias("value"))
    alone = each.groupBy("value").agg(F.min("id").alias("id"), F.max("id").alias("_other"))
    return alone.filter(F.col("id") == F.col("_other")).groupBy("id").agg(F.count("*").alias("own"))


def linkable(members: DataFrame, percent: int) -> DataFrame:
    """The members that may reach the threshold with some member of their bucket.

    Of two classes with n and m shingles, of which the first has ``own`` for itself, at most
    n - own are common and at least m + own are in the union.
    """
    least = members.groupBy("bucket").agg(F.min("n").alias("_least"))
    return (
        members.join(least, "bucket")
        .filter((F.col("n") - F.col("own")) * 100 >= (F.col("_least") + F.col("own")) * percent)
        .drop("_least")
    )


def rare_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """``bucket`` (a shingle), ``id``, ``n`` and ``own`` (how many of its shingles come before).

    Shingles are ordered by the number of classes that have them. Sets that reach the threshold
    share ``percent`` of either, so that they share one of the first n - percent * n + 1 of each.
    """
    each = sets.select("id", F.explode("values").alias("value"))
    shared = settle(each.groupBy("value").agg(F.count("*").alias("_classes")).filter("_classes > 1"))
    place = F.struct(F.coalesce("_classes", F.lit(1)).alias("classes"), "value")
    ordered = (
        each.join(shared, "value", "left")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(place)).alias("_values"))
        .withColumn("n", F.size("_values"))
    )
    first = F.slice("_values", F.lit(1), F.expr(f"n - cast(ceil(n * {percent} / 100.0) as int) + 1"))
    placed = ordered.select("id", "n", F.posexplode(first).alias("own", "_value"))
    return placed.filter("_value.classes > 1").select(
        F.col("_value.value").alias("bucket"), "id", "n", "own"
    )


def undecided(members: DataFrame) -> DataFrame:
    """The members of buckets with more than one component."""
    several = (
        members.groupBy("bucket")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .filter("_low < _high")
        .select("bucket")
    )
    return members.join(several, "bucket")


def round_pairs(members: DataFrame, pivots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the first ``pivots`` members of each bucket with the later ones in other
    components, if they may reach the threshold, and the members that stay for the next round.

    ``members`` has ``bucket``, ``id``, ``n``, ``own`` and ``component``. Map tasks cut their part
    of a bucket to its first members before the shuffle.
    """
    open_members = settle(undecided(members.withColumn("place", F.struct("own", "id"))))
    first = first_per_group(open_members, ["bucket"], [F.col("place")], pivots, "_number")
    some = F.expr(f"(_number - 1) div {HEADS}")  # rows of pivots have a fixed size
    heads = first.groupBy("bucket", some.alias("_some")).agg(
        F.collect_list(F.struct("place", "component", "n")).alias("heads")
    )
    joined = open_members.join(heads.drop("_some"), "bucket")

    def may_link(head: Column) -> Column:
        most = F.least(head["n"] - head["place"]["own"], F.col("n") - F.col("own"))
        return most * 100 >= (head["n"] + F.col("n") - most) * percent

    met = F.filter(
        "heads",
        lambda h: (h["place"] < F.col("place")) & (h["component"] != F.col("component")) & may_link(h),
    )
    pairs = joined.select(F.explode(met).alias("head"), F.col("id").alias("b"))
    last = first.groupBy("bucket").agg(F.max("place").alias("last"))
    rest = open_members.join(last, "bucket").filter(F.col("place") > F.col("last"))
    rest = rest.select("bucket", "id", "n", "own")
    return pairs.select(F.col("head.place.id").alias("a"), "b").distinct(), rest


def _ties(named: DataFrame, classes: DataFrame) -> DataFrame:
    """``a``, ``b``: links between the classes of one id."""
    several = (
        named.groupBy("id")
        .agg(F.min("digest").alias("_first"), F.max("digest").alias("_last"))
        .filter("_first < _last")
        .select("id", "_first")
    )
    of_ids = settle(named.select("id", "digest").join(several, "id").distinct())
    first = classes.select(F.col("digest").alias("_first"), F.col("id").alias("a"))
    other = classes.select("digest", F.col("id").alias("b"))
    return of_ids.join(first, "_first").join(other, "digest").filter("a <> b").select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = 3,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: the key, ``n_shingles`` (long), ``component_id`` (the smallest key reachable over
    links) and ``kept`` (it is that key)."""
    signed = settle(signatures(docs, shingle, key, text))
    named = signed.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    # classes get numbers of their own, as one id may have several texts; written, they stay
    classes = settle(
        named.groupBy("digest")
        .agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("signature").alias("signature"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    banded = buckets(classes)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket")
    members = settle(banded.join(shared, "bucket"))
    candidates = settle(members.select("id").distinct())
    signs = settle(classes.join(candidates, "id", "left_semi"))
    # full sets of the classes that share a bucket with another, each read once; the ids of these
    # classes go to the texts, as texts and sets are many times larger
    texts = docs.select(key, F.col(text).alias("text")).join(
        small(signs.select("least"), WANTED), F.col(key) == F.col("least"), "left_semi"
    )
    sets = settle(
        shingle_sets(texts.dropDuplicates(), shingle, key, "text")
        .withColumnRenamed("id", "least")
        .join(small(signs.select("id", "least", "digest"), NAMED), ["least", "digest"])
        .select("id", "values")
    )
    ties = settle(_ties(named, classes))

    sized = settle(
        signs.select("id", "digest", "n", "signature")
        .join(own_shingles(sets), "id", "left")
        .select("id", "n", "signature", F.coalesce("own", F.lit(0)).alias("own"))
    )
    tied = ties.select("a").unionByName(ties.select(F.col("b").alias("a"))).withColumnRenamed("a", "id")
    nodes = settle(candidates.unionByName(tied).distinct())
    labels, all_links, pivots = settle(components(nodes, ties)), ties, 1
    open_members = linkable(members.join(sized.select("id", "n", "own"), "id"), percent)
    while True:
        pairs, rest = round_pairs(open_members.join(labels, "id"), pivots, percent)
        pairs, rest = settle(pairs), settle(rest)
        if not pairs.isEmpty():
            found = settle(links(promising(pairs, sized, percent), sets, percent))
            all_links = settle(all_links.unionByName(found))
            labels = settle(components(nodes, all_links))
        if rest.isEmpty():
            break
        if pivots == 1:
            still = undecided(rest.join(labels, "id")).select("id").distinct()
            finer = rare_buckets(sets.join(still, "id", "left_semi"), percent)
            rest = settle(linkable(finer, percent))
        open_members = rest
        pivots *= 4

    # the smallest document of a component names it
    placed = settle(classes.select("id", "digest", "least").join(labels, "id", "left"))
    names = placed.filter("component is not null").groupBy("component").agg(F.min("least").alias("_name"))
    of_class = placed.join(names, "component", "left").select(
        "digest", F.coalesce("_name", "least").alias("component")
    )
    out = signed.select("id", "digest", F.col("n").cast("long").alias("n_shingles")).join(
        of_class, "digest", "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
