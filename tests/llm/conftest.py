import pytest

SF = "/root/testdata/sf0.01"
#: NULLs, empty, blank and long texts, repeated rows, ties, an id without a value.
EDGE = [
    (1, "The cat sat on the mat. The dog lay on the rug by the door today."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one"),
    (5, "one"),
    (7, "The cat sat on the mat. The dog lay on the rug by the door today."),
    (8, "word " * 30_000),
    (None, "An id is missing here, but the text is still a text like any other."),
    (10, "Éaßb ć \U0001f600 x y z 12"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """(doc_id, text) of EDGE with columns whose names operators use inside."""
    rows = [(i, t, "s", 1, 2, 3, "h", 0, 0) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, range int, fp long, h string, copies long, score double".replace("score double", "score int"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
