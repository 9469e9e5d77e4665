import pytest


def rows(spark, texts, **extra):
    """A table like ``documents``, with a clashing and a foreign column."""
    data = [(i, t, "en", "s", 0, "clash") for i, t in texts]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rep string")


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: rows(spark, list(texts))


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and very long texts, repeated rows, odd characters."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
    return [
        (None, "a text without an id that is long enough to hold fifty bytes and more words"), (None, None), (1, None), (2, ""), (3, "   \n\t\n"),
        (4, long), (5, "plain words in a line\nplain words in a line\n\nplain words in a line"), (6, "x" * 70_000), (7, "naïve ▁ \U0001f600 \x00 ́x"),
        (5, "plain words in a line\nplain words in a line\n\nplain words in a line"), (-3, "|| ## <|endoftext|> $$"), (9, long + " end"),
    ]
