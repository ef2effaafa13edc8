import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table, with a column that has the name of a result column."""
    def make(rows, extra=True):
        full = [(i, t, "en", "s", None if t is None else len(t), 7) for i, t in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
        return df if extra else df.drop("score")
    return make


@pytest.fixture
def by_id():
    def collect(df):
        return {r["doc_id"]: r for r in df.collect()}
    return collect


#: nulls, empty and blank texts, repeated rows, an id used twice, no id, control characters, other scripts, one very long word
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "the same text of a few words"), (4, "the same text of a few words"), (5, "the same text of a few words"),
       (6, "one"), (6, "another text with this id"), (None, "a text without id"), (None, None), (7, "é ñ 漢字 😀   x\r\n\x0b\x0c end"), (8, "x" * 70_000),
       (9, " ".join(f"w{i % 977}" for i in range(30_000)))]


@pytest.fixture
def odd():
    return list(ODD)
