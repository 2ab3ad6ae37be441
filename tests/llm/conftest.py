import pytest

pytest.importorskip("crawlspan.llm")

EDGE = [
    # id, text, lang, source: nulls, empties, blanks, repeats, ties
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two three", "en", None), (4, "one two three", "en", None), (None, "no id at all", None, "b"), (6, "1234 !!", "fr", "b"), (7, "é" * 3, "fr", "a"), (8, "word " * 30_000, "de", "a"),
]
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, DOCS)
    for c in ("score", "n", "a", "key", "kind", "tkey", "row", "size", "target", "leaks", "spans", "n_chars", "bits", "range", "toxic"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
