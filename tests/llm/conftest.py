import pytest

from trendloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, partitions=4)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing column names."""
    base = " ".join(f"word{i} and{i % 7}" for i in range(120))
    rows = [
        (1, base, "x", 1),
        (2, base, "x", 2),
        (2, base, "x", 2),
        (3, base.replace("word5 ", "other "), None, 3),
        (4, None, "y", None),
        (5, "", "y", 0),
        (6, "Hi", None, 0),
        (None, "no id at all", "z", 0),
        (7, "long " * 9000 + base, "z", 9),
        (8, "Ünïcödé 漢字 \x1c <|endoftext|> 12½", "z", 4),
        (9, "   \n\t ", "z", 4),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, n_words string, length int"
    )


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
