from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977} and{k % 13}" for k in range(12_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "src0", 1, "x"),
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "src0", 1, "x"),
        (2, None, "en", "src0", None, None),
        (3, "", None, None, 0, "y"),
        (4, " \t\n ", "de", "src1", 4, "y"),
        (5, "one", "xx", "src1", 3, "y"),
        (6, long, "en", "src2", len(long), "z"),
        (7, long, "en", "src2", len(long), "z"),
        (None, "no id here at all, mail me at a.b@c.org", "fr", "src2", 10, "z"),
        (8, "ünïcödé ▁ text \u0000 with <s> marks </s> \U0001f600 and 日本語 words", "ja", "", 10, "z"),
        (9, "Licensed under CC BY-NC 4.0. All rights reserved.", "en", "src0", 10, "z"),
        (1, "another text of the same document id", "en", "src0", 1, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string")
    return df.select("*", df["n"].alias("node"), df["n"].alias("component"), df["n"].alias("score"), df["n"].alias("t"), df["n"].alias("cell"), df["n"].alias("key"))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(12)] + [(None, 1, 1), (5, None, None), (6, 0, 1), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
