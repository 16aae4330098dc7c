import pytest

WORDS = [f"w{i}" for i in range(300)]
LONG = " ".join(f"word{i % 997}x{i}" for i in range(6000))
#: Ids that are null and repeated, texts that are null, empty, blank, very long, short, of another script, and repeated rows.
ROWS = [
    (1, " ".join(WORDS[:120]), "b", 5),
    (1, " ".join(WORDS[:120]), "b", 5),
    (2, None, "a", 1),
    (None, "only a few words here, and no id", None, 2),
    (None, None, None, None),
    (3, "", "a", 3),
    (4, " \t\n\x0b\x0c\r ", "c", 3),
    (5, LONG, "a", 9),
    (6, "日本語 テキスト é ünïcode \u00a0 nbsp", "b", 1),
    (7, " ".join(WORDS[:60] + ["other"] + WORDS[60:120]), "b", 2),
    (8, "same same same same same same same same same same same same", "a", 4),
]
SCHEMA = "doc_id long, text string, source string, size int, score string, `Text Extra` int"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents of every awkward kind, with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, source string, size int, score string, extra int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size int, score string, extra int")


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
