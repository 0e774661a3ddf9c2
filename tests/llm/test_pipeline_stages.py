"""Every stage of the corpus pipeline on its own, and all of them in a row."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from trendloom.llm import packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, score string, row int"


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


@pytest.fixture(scope="module")
def texts():
    passage = words("shared", 60)
    item = words("bench", 30)
    rows = {i: f"{words(f'doc{i}x', 80)} plain and calm" for i in range(40)}
    rows |= {i: f"{words(f'doc{i}x', 80)} you utter moron" for i in range(40, 56)}
    rows |= {60: rows[1], 61: rows[2] + " extra", 62: words("only", 50) + " plain and calm " + passage}
    rows |= {63: passage + " " + words("tail", 50) + " plain and calm", 64: item + " plain and calm"}
    rows |= {65: words("around", 20) + " " + words("other", 30) + " plain and calm", 66: None, 67: "", 68: "a\tb plain and calm"}
    return rows, item


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    rows, item = texts
    out = tmp_path_factory.mktemp("tables")
    made = [(i, t, "en", "s", len(t or ""), "mine", 7, "s", 1) for i, t in rows.items()]
    made += [(None, "no id, plain and calm", None, None, 3, "mine", 7, "s", 1)] * 2 + [made[3], made[3]]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(40 <= i < 56)) for i in range(56) if zlib.crc32(str(i).encode()) % 4 != 2]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, words("other", 30))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def ids(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=str)


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole(frame):
    return sorted(map(str, frame.collect()))


def test_toxic_documents_go(spark, folder):
    docs = documents(spark, folder)
    left = pipeline.drop_toxic(spark, docs, folder)
    assert whole(left) == whole(docs.filter("doc_id is null or doc_id not between 40 and 55"))
    assert left.columns == docs.columns


def test_nothing_is_toxic_without_both_labels(spark, folder, tmp_path):
    docs = documents(spark, folder)
    for n, rows in enumerate([[], [(0, 0), (1, 0)], [(40, 1)]]):
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert whole(pipeline.drop_toxic(spark, docs, f"{tmp_path}/{n}")) == whole(docs)


def test_texts_without_words_are_never_toxic(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "THRESHOLD", 0.0)
    left = pipeline.drop_toxic(spark, documents(spark, folder), folder)
    assert ids(left) == [66, 67]


def test_one_of_near_copies_stays(spark, folder):
    docs = documents(spark, folder)
    left = pipeline.drop_near_duplicates(spark, docs, folder)
    want = docs.filter("doc_id is null or doc_id not in (60, 61)")
    assert whole(left) == whole(want.filter("doc_id is null or doc_id <> 3").unionByName(want.filter("doc_id = 3").limit(1)))


def test_repeated_spans_go(spark, folder):
    docs = documents(spark, folder).filter("doc_id in (5, 62, 63, 66, 67)")
    rows = {r["doc_id"]: r for r in pipeline.drop_repeated_spans(spark, docs, folder).collect()}
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    count = {}
    for t in data.values():
        for k in range(len(t) - 199):
            count[t[k : k + 200]] = count.get(t[k : k + 200], 0) + 1
    for i, t in data.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want = bytes(b for b, g in zip(t, gone) if not g).decode()
        assert (rows[i]["text"] or "") == want and rows[i]["n_chars"] == len(want)
        assert (rows[i]["n_words"], rows[i]["kept"], rows[i]["score"], rows[i]["row"]) == ("mine", 7, "s", 1)
    assert rows[66]["text"] is None and len(rows[62]["text"]) < 400


def test_contaminated_documents_go(spark, folder):
    docs = documents(spark, folder)
    left = pipeline.drop_contaminated(spark, docs, folder)
    assert whole(left) == whole(docs.filter("doc_id is null or doc_id not in (64, 65)"))


def test_all_stages_in_a_row(spark, folder):
    packed = pipeline.run(spark, folder)
    found = {r["doc_id"] for r in packed.collect()}
    gone = {*range(40, 56), 60, 61, 64, 65}
    assert found == {*range(40), 62, 63, 66, 67, 68, None}
    assert not found & gone
    places = {}
    for r in packed.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    docs = documents(spark, folder)
    for name, stage in pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    assert re.fullmatch("[a-z_ ]+", " ".join(n for n, _ in pipeline.STAGES))
