"""Documents with the awkward rows every operator must handle."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, " \n\t ", "en", "a", 4),
        (4, "word", "en", "a", 4),
        (4, "word", "en", "a", 4),
        (None, "no id here at all", "en", "a", 17),
        (5, "x" * 100_000, "en", "a", 100_000),
        (6, "a b " * 30_000, "en", "a", 120_000),
        (7, "Tie tie TIE.\nTie tie TIE.\n", "en", "a", 26),
        (8, "日本語 テキスト 😀 naïve é \x00   end", "ja", "a", 30),
    ]
    base = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "words string, rank string, bucket string, length string, kind string, label string, n string, key string"
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], f"{base}, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
