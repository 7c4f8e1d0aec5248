import pytest

EDGE = [
    (0, "", "en", "s1", 0),
    (1, None, "en", None, 0),
    (2, "one two three four five six seven", "en", "s1", 7),
    (3, "one two three four five six seven", "de", "s2", 7),
    (3, "One two\tthree four five six SEVEN", "de", "s2", 7),
    (4, " \n\t ", None, "s2", 3),
    (5, "a b", "fr", "s2", 2),
    (6, "a  B", "fr", "s3", 2),
    (None, "lonely words of a row without an id", "en", "s1", 1),
    (7, "löng " * 400_000, "es", "s9", 1),
    (8, "x" * 50_000, "es", "s9", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated ids, and columns whose names operators use inside."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr(
        "*", "'x' AS key", "1 AS size", "2 AS bucket", "3 AS shard", "4 AS w", "5 AS block", "'y' AS tokens", "0.5 AS score", "6 AS part",
        "7 AS node"
    )


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
