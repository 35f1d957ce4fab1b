import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and ids, odd characters."""
    rnd = random.Random(4)
    long = prose(rnd, 20_000)
    rows = [
        (1, prose(rnd, 60), "en", "s", 1), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "   \n\t ", "en", "s", 5), (5, long, "en", "s", 9), (6, long + " tail", "en", "s", 9), (7, prose(rnd, 40), "en", "s", 3),
        (7, prose(rnd, 41), "en", "s", 3), (8, "same text here for all of us", "en", "s", 3), (8, "same text here for all of us", "en", "s", 3), (9, "same text here for all of us", None, "s", 3), (None, "no id at all", "en", "s", 1),
        (10, "Ünïcode ▁mark▁ 日本語 😀 é́  two  blanks \n\n x\t", "de", "s", 2), (11, "12345 !!! ???", "en", "s", 3), (12, "<|endoftext|> #$%& " * 9, "en", "s", 3), (13, "nul \x00 byte and \x7f", "en", "s", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """Columns with names that operators use for results."""
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit("mine") for c in ("score", "kept", "n_words", "spans", "ids", "class_id", "node", "label", "shard", "h1", "keys", "features")})
