from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=1):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "   \n\t ", "en", "s", 6),
        (4, long, "en", "s", len(long)),
        (5, long, None, "s", len(long)),
        (6, "one two three", "en", "s", 13),
        (6, "one two three", "en", "s", 13),
        (7, "日本語 \u2581 text\x00 with\u00a0odd é\u0301 \U0001f600 marks", "fr", None, None),
        (None, "no id here at all", "de", "s", 17),
        (None, "no id here at all", "de", "s", 17),
    ]
    columns = SCHEMA + ", key long, fp long, h long, at int, score double, group_size int, n_bytes int, component_id int, spans string, start int"
    return spark.createDataFrame([r + (None,) * 10 for r in rows], columns)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
