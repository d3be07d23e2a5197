import pytest

#: Column names that operators might use inside.
CLASHES = ["size", "key", "score", "fp", "block", "x", "row", "n", "words", "digest", "label",
           "target", "base", "part", "draws", "bucket", "component", "t", "ws", "positive"]


def schema(extra=CLASHES):
    return ("doc_id long, text string, lang string, source string, n_chars long, "
            + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs in any column, empty, blank and very long texts, ties, repeated
    rows, and extra columns with clashing names."""
    body = " ".join(f"wort{i % 37} das haus{i % 11} und" for i in range(60))
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (None, body, "de", "b"),
            (3, body, None, "b"), (4, body + " x", "de", None), (4, body + " x", "de", None),
            (5, " \n\t ", "en", "a"), (6, "one", "en", "a"), (7, "ONE", "en", "c"),
            (8, "lorem ipsum dolor " * 40_000, "la", "c"), (9, "ü€😀 x\x1cy", None, None)]
    rows = [(*r, None if r[1] is None else len(r[1]), *["v"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(rows, schema())


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], schema())


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, None), (6, None, 0), (None, 1, 0),
                                  (8, 0, 1)], "doc_id long, quality int, toxic int")
