"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes what its predecessor has kept and written, works on all of it, and returns the
columns of ``documents``; the last one returns the packed pieces. Stages change texts or drop rows
by their own decision alone; clean documents stay. Columns of the documents may have any names and
stay as they are, but for texts that lose bytes and their ``n_chars``. Null texts count as empty and
pass every filter; rows with a null id are never copies of others; without labels of both kinds no
document is toxic; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import decontamination, near_duplicates, packing, substring_duplicates, toxicity
from trendloom.llm.common import small, table
from trendloom.llm.queries import vocabulary
from trendloom.session import settle


def _with_text(docs: DataFrame) -> DataFrame:
    """The texts, and beside them the other columns as one, so that no names clash."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.col("text").isNull().alias("_null"))
    return docs.select(others.alias("row"), "text")


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from a frame with ``row`` and ``text``; null texts are null again."""
    text = F.when(~F.col("row._null"), F.col("text"))
    new = {"text": text, **changed}
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the model is learnt from their labels. Texts
    without words stay: the score says nothing of them."""
    model = settle(toxicity.train(docs, table(spark, sf_dir, "labels")))
    if model.isEmpty():
        return docs
    scored = toxicity.score(_with_text(docs), model)
    judged = toxicity.rejected(F.col("score")) & (F.col("n_features") > 0)
    return scored.filter(~judged).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of their five-word shingles in common) stays,
    that with the smallest id. Of rows that share id and text one stays."""
    judged = near_duplicates.near_duplicates(docs, percent=80, shingle=5)
    dropped = settle(judged.filter("not kept").select(F.col("doc_id").alias("_id")).distinct())
    left = docs.join(small(dropped), docs["doc_id"] == dropped["_id"], "left_anti")
    # only ids that repeat are looked at again, so that other texts are not shuffled
    again = settle(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")))
    repeats = left["doc_id"] == again["_id"]
    once, several = (left.join(small(again), repeats, how) for how in ("left_anti", "left_semi"))
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of repeated windows. Their documents stay, shorter."""
    kept = substring_duplicates.remove_repeats(_with_text(docs))
    changed = F.col("n_removed") > 0
    size = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.select(*_columns(docs, n_chars=size))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences, and the pieces' checksums."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), vocabulary(), added=True)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# a learnt model and token ids are beyond SQL; tests/llm holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
