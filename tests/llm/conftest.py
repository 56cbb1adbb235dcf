import pytest
from pyspark.sql import Row

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
#: Extra columns have names that the operators use themselves.
EXTRA = ("key", "row_", "fingerprint", "node", "spans", "score", "kept", "n_words", "place_", "ids", "part", "document", "salt")
DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
EN = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old garden near a quiet river and many people walk by every morning"
DE = "der schnelle braune Fuchs springt über den faulen Hund während sieben kleine Vögel im alten Garten singen und viele Leute jeden Morgen vorbeigehen"


def numbered(base: str, i: int) -> str:
    """Sixty words and more, others for every i."""
    return " ".join(f"{w}{(i * 7 + k) % 53}" for k, w in enumerate(" ".join([base] * 3).split()))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, LONG, "en", "a"), (5, LONG, None, None), (None, "nobody knows this text at all", "en", "a"),
            (6, "same words here", "en", "a"), (6, "same words here", "en", "a"), (7, "same words here", "en", "b"), (8, "12 34 !!", "en", "b"), (9, "x", None, None)]
    rows += [(10 + i, numbered(EN, i), "en", "a") for i in range(8)] + [(30 + i, numbered(DE, i), "de", "b") for i in range(8)]
    return [Row(*r, 5, *EXTRA) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS_SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, edge_docs):
    """A folder with the tables of the queries, with nulls, ties and repeated rows."""
    base = str(tmp_path_factory.mktemp("tables"))
    edge_docs.write.parquet(f"{base}/documents.parquet")
    html = "<p>" + "long page " * 200
    pages = [(1, "http://a/1", html), (2, None, html), (3, "http://a/3\r\nX: y", html), (3, "http://a/3", html), (None, "u", html), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "ü", "ä" * 40_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return base
