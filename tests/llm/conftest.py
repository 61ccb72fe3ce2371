from __future__ import annotations

import pytest

#: Names that the operators use inside themselves.
CLASHING = {"digest": "d", "n": 5, "fp": 1, "word": "w", "bits": 2, "line": "x", "value": 3, "id": 9, "tag": 4, "row": 6, "keys": "k"}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, ties, repeated rows, a long text, and columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog while seven wizards mix potions in the old quiet tower. " * 3
    texts = [
        (1, base), (2, base.replace(" ", "  ")), (3, None), (4, ""), (5, " \t\n"), (6, base), (6, base), (None, base), (None, None), (7, "a"),
        (8, base.replace("seven", "eight")), (9, "x y\nx y\n\nx z"), (10, "word " * 30_000), (11, "don't <|endoftext|> İ ΑΣ \x1c é́"), (2**60 + 1, "big id"),
    ]
    rows = [(i, t, *CLASHING.values()) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in CLASHING.items()))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


def ids_of(frame):
    return sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x or 0))
