"""The queries give the ids of the tokenizers library's own default, added tokens included."""

import zlib

import numpy as np
import corpus_pipeline
from tokenizers import Tokenizer

from trendloom.llm import queries
from trendloom.llm.tokens import Encoder

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext| >", "漢字 <|endoftext|> é", "plain", ""]


def library_ids():
    plain = Tokenizer.from_file(queries.vocabulary())
    return [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_encoder_equals_the_library():
    encode = Encoder(queries.vocabulary(), added=True).encode
    want = library_ids()
    assert want[0] == [87, 220, 50256, 331]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in TEXTS] == want


def test_queries_equal_the_library(spark, tmp_path):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(library_ids())}
    packed = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packed} == want
    written = queries.op10_arrow_sequences(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in written} == want
    staged = corpus_pipeline.pack_sequences(spark, frame, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in staged} == want
