import random

import pytest

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows and columns with clashing names."""
    rows = [
        (1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", "a"), (3, prose(1, 59) + " end", "en", "b"), (4, None, "de", "a"), (5, "", None, None),
        (6, "  \n ", "en", "a"), (7, "one", "en", "c"), (8, "One", "fr", "a"), (None, prose(2, 30), "en", "a"), (None, None, None, None),
        (9, prose(3, 30000), "en", "a"), (10, prose(4, 40), "en", "a"), (10, prose(4, 40), "en", "a"), (11, "!!! ... ???", "en", "a"), (12, "Zażółć gęślą jaźń идея 漢字", "pl", "b"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, "x", 0) for i, t, la, s in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
