from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone lamp quick brown under over market window letter garden north south bright early paper iron glass".split()


def prose(seed: int, n: int, extra: str = "") -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randint(0, 400)}{extra}" for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with the names that operators use inside."""
    rows = [
        (1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, " \n\t "), (None, prose(2, 60)), (None, None),
        (6, "x" * 60_000), (7, prose(3, 9000)), (8, "one\n\ntwo\none"), (9, "ünï ß \U0001f600 word"), (10, "\x00 null byte"),
    ]
    data = [(i, t, "en", "src", len(t or ""), 7, 7, "s", 1, "r") for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, node long, text_hash long, start string, at long, row string"
    return spark.createDataFrame(data, names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
