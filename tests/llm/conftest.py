import random

import pytest

LONG = "doc_id long, text string, lang string, source string, n_chars long, shard int, h string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma,", "Délta.", "ÉCHO", "x1", "of", "the", "*star*", "##"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(n))
    rows = [(i, text(rng.randrange(120)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "", None]), None, 1, "h") for i in range(60)]
    rows += [(100, None, None, None, None, None, None), (None, "no id of its own here", "en", "a", 3, 1, "h"), (None, None, None, None, None, None, None)]
    rows += [(101, "", "en", "b", 0, 1, "h"), (102, " \n\t\x0b", "en", "b", 4, 1, "h"), (103, text(9000), "en", "c", 1, 1, "h")]
    rows += [rows[3], rows[3], (200, rows[3][1], "en", "a", 1, 1, "h"), (104, "one", "en", "d", 3, 1, "h")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_documents):
    return spark.createDataFrame(odd_documents, LONG).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], LONG)
