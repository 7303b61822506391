from __future__ import annotations

import re
from datetime import date

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from here", None, "k", 1, date(2020, 1, 1)),
        (2, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "k", 2, None),
        (2, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "k", 2, None),
        (3, None, None, None, None, None),
        (4, "", "en", "", 0, None),
        (5, long, "en", "long", 5, None),
        (6, "!!! ... \n\n\t", "en", "s", 3, None),
        (6, "same id, another text", "en", "s", 3, None),
        (None, "no id at all but words enough to be a text", "en", "s", 3, None),
        (7, "short one", "en", "s", 3, None),
        (8, "ÄÖÜ ça va? <|endoftext|> 日本語 İ", "de", "s", 3, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, k string, score long, root date").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
