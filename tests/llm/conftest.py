import pytest

CLASHING = "doc_id long, text string, row int, id long, content long, spans string, score string, component int, _other int, key int, cluster int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and blank texts, a long text, repeated rows and ids, and columns of the names used inside."""
    long = " ".join(f"word{i % 977} long{i % 31}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, long), (5, "the same text of some words that is long enough to count as one"),
             (5, "the same text of some words that is long enough to count as one"), (None, "no id here"), (None, None),
             (6, "the same text of some words that is long enough to count as one"), (7, "password = hunter22 é😀 token:abc")]
    return spark.createDataFrame([(i, t, 1, 2, 3, "s", "x", 4, 5, 6, 7) for i, t in texts], CLASHING)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)
