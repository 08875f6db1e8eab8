import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, fp string, size long, _row string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(WORDS[i * i % 20] + str(i % 97) for i in range(30_000))
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, "  \n\t ", None, "b"), (3, long, "en", None), (4, long + " end", "en", "b"),
        (5, "Same text here.\nAnd here.", "en", "a"), (6, "Same text here.\nAnd here.", "en", "b"), (6, "Same text here.\nAnd here.", "en", "b"),
        (None, "Same text here.\nAnd here.", None, None), (None, None, None, None), (9, "x", "fr", "c"), (10, "one two", "fr", "c"),
        (11, "É ñ ß 漢字 \U0001f600 text", "fr", "d"), (12, "a\x0bb\x0cc\x1cd\u00a0e", "fr", "e"), (13, "\n".join(["line"] * 500), "en", "f"),
        (5, "Another text under a used id.", "en", "a"),
    ]
    return spark.createDataFrame([(*r, "clash", 7, "row", "k") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
