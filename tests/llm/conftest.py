import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = "word " * 3000 + "end"


def rows(texts, start=1):
    return [(start + k, t, "en", f"s{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns that operators use."""
    data = rows([None, "", "  \t\n ", "a b c", "a  b\tc", "abc", LONG, "é 日本 😀 ▁ x", "one\ntwo\none", "x" * 5000])
    data += [(4, "a b c", "en", "s1", 5), (None, "a b c", None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    names = ("id", "norm", "sha", "kept", "score", "key", "n_words", "component_id", "sequence_id", "row", "shard")
    docs = spark.createDataFrame(data, DOCS)
    return docs.selectExpr("*", *[f"'x' AS {n}" for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
