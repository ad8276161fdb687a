import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, mark string, part string, fp string, starts int, key string, n_copies double"
LONG = " ".join(f"word{i % 9973} is{i}" for i in range(60_000))


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en" if doc_id else None, source, len(text) if text is not None else None, 7, "m", None, "f", None, "k", 0.5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, equal texts and equal rows, and columns with clashing names."""
    rows = [doc(1, "one two three four five six"), doc(2, None), doc(3, ""), doc(4, " \t\n"), doc(5, LONG), doc(6, "one two three four five six"), doc(7, "žluťoučký kůň 😀 中文字符没有空格 naïve", None), doc(None, "no id here at all", "b"), doc(None, None, None), doc(8, "one", "b"), doc(8, "one", "b"), doc(9, "x" * 50_000, "c"), doc(10, "ab\u00a0cd\u2003ef\x1cgh's I'll  go\n\n\nx", "c")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
