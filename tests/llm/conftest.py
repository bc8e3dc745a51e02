import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids binary, shard int, origin long, tie long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing column names."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "the quick brown fox", "en"), (2, None, None), (3, "", "en"), (None, "no key", "en"), (None, None, None), (4, long_text, "de"), (5, "a b", "en"), (5, "a b", "en"), (5, "c", "en"), (6, " \n\t ", "fr"), (7, "é" + chr(0x301) + " <|endoftext|> 🙂", "fr"), (-8, "the quick brown fox", "en")]
    return spark.createDataFrame([(d, t, g, None, 0, 0.5, None, 3, 9, 1) for d, t, g in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
