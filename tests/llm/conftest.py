from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra_id bigint, n bigint, kind string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents with odd extra columns, in two partitions."""

    def make(pairs, parts=2):
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "k") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null ids and texts, empty, blank and long texts, ties, repeated rows, odd characters."""
    base = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
    return make_docs(
        [
            (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "one two three"), (6, base), (7, base), (8, base + " tail"), (8, base + " tail"),
            (None, base), (None, None), (9, "naïve ΣΑΣ 日本語 😀😀 don't  I'LL\r\n12345 #$%"), (10, "x" * 3000), (11, base[:900] + " zz " + base[900:]), (12, "solo " * 300),
            (13, " ".join(f"u{i}" for i in range(120)) + " " + base[:1200]), (-5, base[300:1500]), (14, "\x00 nul \x00"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
