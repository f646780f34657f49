import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_rows():
    """(doc_id, text) of the smallest documents table."""
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    return [tuple(r.values()) for r in table.to_pylist()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, long texts, words of many kinds."""
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "ONE two three"), (7, "one two three"),
        (7, "one two three"), (8, "word " * 50_000), (9, "x" * 200_000), (10, "é中文 ñandú " * 300), (11, "\x00\x01 a\x00b"),
        (12, "mit license MIT License, mit-license"), (13, "Mit license"), (14, "The MIT   License"), (15, "a b c d e f g h i j k l"),
    ]


def documents(spark, rows, **more):
    """A documents table with extra columns whose names operators may use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "concat('s', doc_id % 3) as source", "length(text) as n_chars", "1 as block", "2 as fp", "'k' as bucket", "0 as rest")
