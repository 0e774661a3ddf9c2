import random
import re

import pytest
from pyspark.sql import functions as F

from trendloom.functions import scalars, text
from trendloom.operators import ingest


def applied(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in frame.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_accents(spark):
    found = applied(spark, ['Schr\\"odinger', "\\'E", "\\r{A}", "{\\ss}", "\\^o", "\\^A", "{\\oe}"], text.clean_accents)
    assert found == ["Schrödinger", "É", "Å", "ß", "\\^o", "Â", "œ"]


def test_formulae_and_artefacts(spark):
    cases = {
        "$x$": "x", "$[x]$": "x", "$\\alpha$": "alpha", "$\\mathcal{O}$": "O", "$\\BbbR$": "R", "$a+b$": "(formula)",
        "$$a+1$b+1$$": "(formula)", "$$a$b$$": "(formula)$",  # the inner $a$ is taken first
        "cost $5": "cost $5", "a\n b": "a b", "(Abridged) t": " t", "Context: t": " t", "[abridged.]": "",
    }
    assert applied(spark, list(cases), text.clean_text) == list(cases.values())


def test_formula_pattern_on_random_text(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("$$ab \\{}1") for _ in range(rng.randrange(12))) for _ in range(3000)]
    pattern = text.CLEANING[-1][0]
    found = applied(spark, values, lambda c: F.regexp_replace(c, pattern, "(formula)"))
    assert found == [re.sub(pattern, "(formula)", v) for v in values]


def test_long_formula_body(spark):
    assert applied(spark, ["$" + "ab1 " * 50_000 + "$"], text.clean_text) == ["(formula)"]


def test_trimming(spark):
    def trimmed(value):
        return text.trim_sentences(text.split_sentences(value))

    first = "A" * 999 + "."
    long = "B" * 1024 + "."
    values = [f"{first} C{'c' * 21}.", f"{first} C{'c' * 22}.", f"{long} Dd.", f"{first} {'C' * 60}. Dd.", ""]
    found = applied(spark, values, trimmed)
    assert [len(v) for v in found] == [1024, 1000, 1025, 1000, 0]


def test_labels_words_and_terms(spark):
    assert applied(spark, [" '`\"*.?Deep &quot;nets&quot;*? "], text.clean_label) == ["Deep nets"]
    assert applied(spark, ["Été à Paris, x_1 a b2"], text.words) == [["été", "paris", "x_1", "b2"]]
    assert applied(spark, ["the red of red shoe", "a", ""], text.terms) == [
        ["red", "red", "shoe", "red red", "red shoe"], [], [],
    ]
    three = applied(spark, ["one two three four"], lambda c: text.ngrams(text.words(c), 2, 3))
    assert three == [["one two", "two three", "three four", "one two three", "two three four"]]


def record(number, **changes):
    base = {
        "id": f"00{number}", "title": "T", "abstract": "  " + "Word " * 20, "categories": "a.B c",
        "versions": [{"version": "v1", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}], "update_date": "2010-01-02",
    }
    return {**base, **changes}


@pytest.fixture(scope="module")
def records(spark):
    from trendloom.schemas import SNAPSHOT

    late = [{"version": "v2", "created": "Tue, 1 Jan 2008 00:00:00 GMT"}, {"version": "v1", "created": "Sat, 1 Apr 2000 10:00:00 GMT"}]
    rows = [
        record(1), record(2, versions=late), record(3, versions=late[:1]), record(4, update_date="2010-01-01"),
        record(5, abstract=" Withdrawn by author" + " x" * 50), record(6, abstract=" withdrawn by author" + " x" * 50),
        record(7, abstract="x" * 63), record(8, abstract="x" * 64), record(9, abstract="x" * 1025),
        record(10, categories="a.B c d e"),
    ]
    return spark.createDataFrame(rows, SNAPSHOT)


def test_import(spark, records):
    stages = ingest.clean_snapshot(records, 2000, "2010-01-01")
    found = {r.id: r for r in stages.collect()}
    assert "003" not in found and "004" not in found  # no first version; not after the mark
    assert str(found["002"].creation_date) == "2000-04-01"
    assert {i: found[i].stage for i in ("005", "006", "007", "008", "009")} == {
        "005": "withdrawn", "006": "imported", "007": "short", "008": "imported", "009": "untrimmable",
    }
    report = ingest.import_report(stages).first().asDict()
    assert report == {"total": 8, "imported": 5, "withdrawn": 1, "short": 1, "untrimmable": 1}
    papers = {r.source_id: r.categories for r in ingest.imported_papers(stages).collect()}
    assert papers["001"] == ["a.B", "c"] and papers["0010"] == ["a.B", "c", "d"]


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-1.0] * 33 + [1.0])]
    frame = spark.createDataFrame(rows, "i int, v array<float>")
    found = frame.select(
        "i", scalars.normalize_vector(F.col("v")).alias("u"), scalars.quantize_bits(F.col("v")).alias("b")
    ).orderBy("i").collect()
    assert found[0].u == [0.6, 0.8] and found[1].u is None
    assert [r.b for r in found] == [[3], [0], [0, 1]]
