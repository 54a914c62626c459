import random

import pytest

WORDS = [a + b + c for a in ("ba", "te", "lo", "mi", "su") for b in ("ra", "ne", "ko") for c in ("s", "", "n", "l")]


def prose(seed: int, n: int) -> str:
    dice = random.Random(seed)
    return " ".join(dice.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    dice = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[dice.randrange(len(words))] = f"x{dice.randrange(10**6)}"
    return " ".join(words)


#: Documents with nulls, empty and blank texts, copies, near copies, a repeated row and a very long text.
def documents() -> list[tuple]:
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a", 0),
        (2, base, "en", "a", 0),
        (3, edited(base, 3, 1), None, "b", None),
        (4, edited(base, 4, 2), "en", None, 0),
        (5, None, None, None, None),
        (6, "", "fr", "a", 0),
        (7, " \n\t ", "fr", "b", 0),
        (8, "one two", "fr", "b", 0),
        (9, "one two", "fr", "b", 0),
        (None, base, "en", "a", 0),
        (10, prose(10, 60), "en", "a", 0),
        (10, prose(10, 60), "en", "a", 0),
        (11, "x" * 20_000, "en", "c", 0),
        (12, prose(12, 30_000), "en", "c", 0),
        (13, "é ß 漢字   \xa0 ﬁ 😀 </s> <|endoftext|> " + prose(13, 40), "de", "c", 0),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("doc", "k1", "k2", "n", "bands", "first", "bucket", "component", "tile", "root", "host", "host_key", "salted", "boilerplate", "in_0", "m_0", "q_in_0", "item", "length", "block", "kept", "labels", "word", "trusted", "n_tokens", "n_words", "pass_no", "at", "source_key", "q_text", "n_lines", "text_")
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (12, 1, 0), (10, 0, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
