import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, an empty text, repeated rows, ties, a long text, and columns with clashing names."""
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (None, "a text without an id"), (None, None), (5, "long " * 60_000), (6, "é中 \U0001f600 mixed"), (7, "123 456 !!!")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for name in ("fp", "node", "piece", "score", "size", "shard", "part", "row", "key", "seg", "list"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
