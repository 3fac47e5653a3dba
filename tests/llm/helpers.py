"""Fixtures of awkward rows, and plain reads of tables, for the tests of this folder."""

import pyarrow.parquet as pq

EDGE = [
    (1, "one two three four five six seven", "en", "b", 33),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "one two three four five six seven", "en", "b", 33),
    (4, "one two three four five six seven", "en", "b", 33),
    (5, "é ü \U0001f600 ﬁ <|endoftext|> a\tb\r\n\n c  d", "fr", "a", 30),
    (6, "long " * 30_000, "en", None, 150_000),
    (None, "without an id", "en", "b", 13),
    (8, "   \n ", "en", "c", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", {"a": 1}, 7, 1) for r in EDGE], SCHEMA + ", size string, `odd.name` map<string,int>, part int, n int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(small, name):
    return pq.read_table(f"{small}/{name}.parquet").to_pylist()


def rows(df):
    return [r.asDict() for r in df.collect()]
