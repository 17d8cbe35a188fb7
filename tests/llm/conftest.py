import random

import pytest

DOCS = "doc_id bigint, text string, lang string, key string, score double, words string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "the", "re", "ion", "of", "th", "é", "ou", "st", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def twins(n: int) -> tuple[str, str]:
    """A Thue-Morse string and its complement: sums of powers modulo 2**64 do not tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank, long and repeated texts, equal and null
    ids, and columns named like the operators' own."""
    long = prose(1, 4000)
    rows = [
        (1, "One two three. Four FIVE six, seven!", "en", "k", 1.0, "w"), (2, None, None, None, None, None), (3, "", "", "", 0.0, ""),
        (4, " \n\t ", "en", "k", 1.0, "w"), (5, long, "en", "k", 1.0, "w"), (6, long, "en", "k", 1.0, "w"),
        (7, long + " and a tail", "en", "k", 1.0, "w"), (8, "été 中文 😀 ▁x </s>[INST]", "fr", "k", 1.0, "w"),
        (9, prose(2, 60), "en", "k", 1.0, "w"), (9, prose(2, 60), "en", "k", 1.0, "w"), (9, prose(3, 60), "en", "k", 1.0, "w"),
        (None, prose(4, 60), "en", "k", 1.0, "w"), (None, None, "en", "k", 1.0, "w"), (10, "x" * 900, "en", "k", 1.0, "w"),
        (11, "a\x00b c\x00d", "en", "k", 1.0, "w"), (12, "one", "en", "k", 1.0, "w"),
        *((13 + i, twins(1024)[i], "en", "k", 1.0, "w") for i in range(2)),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
