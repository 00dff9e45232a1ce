from __future__ import annotations

import re

import pytest

SF = "/root/testdata/sf0.001"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))


@pytest.fixture(scope="session")
def words():
    return words_of


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


#: Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids.
EDGES = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
    (2, "alpha  beta\tgamma delta epsilon zeta", "en", "s", 36),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \t\n ", "en", "s", 4),
    (6, "Word " * 60_000, "en", "s", 300_000),
    (6, "Word " * 60_000, "en", "s", 300_000),
    (None, "alpha beta gamma delta epsilon zeta", "en", None, 35),
    (None, "nobody names me", None, "s", 15),
    (None, None, None, None, None),
    (7, "same id one", "en", "s", 11),
    (7, "same id two", "en", "s", 11),
    (8, "x" * 200_000, "en", "s", 200_000),
    (9, "é\u0000ü \U0001f600 ß", "de", "s", 7),
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with columns beside them that clash with names used inside the operators."""
    extra = ("norm", "digest", "id", "key", "h", "n", "rid", "hash", "kept", "score", "item_id", "component", "u", "v", "fold", "good", "block", "text_sha256", "__hit", "bands", "url")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *("clash" for _ in extra)) for r in EDGES], schema)
