"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import (
    arrow_files,
    bitslices,
    chat,
    decontamination,
    near_duplicates,
    packing,
    phrases,
    sharding,
    simhash,
    substring_duplicates,
    toxicity,
    vector_codes,
    warc,
)
from trendloom.llm.common import table
from trendloom.llm.sql import SQL  # noqa: F401  (used by the entry points)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        toxicity.rejected(F.col("score")).cast("int").alias("predicted"),
    )


@query
def op2_best_fit_packing(spark, sf):
    # a store of some 120 MB, so that few pieces are merged again
    pieces = packing.token_pieces(table(spark, sf, "documents"), vocabulary(), added=True, kept=600_000)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op3_sharding(spark, sf):
    placed = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query
def op4_decontamination(spark, sf):
    judged = decontamination.judge(
        table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    )
    return judged.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_chat_format(spark, sf):
    return chat.round_trip(chat.with_marker_case(table(spark, sf, "conversations")))


@query
def op6_warc_revisits(spark, sf):
    folder = warc.write_archives(table(spark, sf, "pages"))
    wanted = {
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha1("payload"),
    }
    found = warc.resolve_revisits(warc.read_archives(spark, folder), wanted)
    return found.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op7_minhash_near_duplicates(spark, sf):
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), percent=85, shingle=3)


@query
def op8_suffix_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring_duplicates.remove_repeats(docs, with_kept=False)


@query
def op9_bit_sliced_top_k(spark, sf):
    vectors = bitslices.quantised(table(spark, sf, "embeddings"))
    return bitslices.top_k(vectors, F.col("id") % 20 == 0)


@query
def op10_arrow_sequences(spark, sf):
    index = arrow_files.write_sequences(table(spark, sf, "documents"), vocabulary(), added=True)
    found = arrow_files.read_documents(index)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op11_phrase_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query
def op12_vector_codes(spark, sf):
    return vector_codes.compress(table(spark, sf, "embeddings"))


@query
def op13_simhash_near_duplicates(spark, sf):
    return simhash.simhash_duplicates(table(spark, sf, "documents"))
