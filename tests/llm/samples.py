"""Rows and fixtures shared by the tests of this folder."""

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHES = ["row", "id", "mark", "starts", "key", "fp", "node", "size", "u", "h1", "pos", "nth", "row_mark", "keep_id",
           "component", "fingerprint", "lines", "keys", "bucket", "quality", "label", "score", "part", "tag"]

PROSE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (None, "no id here", "en", None, 10),
    (None, "no id here", "en", None, 10), (5, PROSE, "en", "b", 60), (6, PROSE, "en", "b", 60), (5, PROSE, "en", "b", 60),
    (7, PROSE.upper(), "fr", None, 60), (8, "a\nb\nc\nd\n\ne", "en", "c", 12), (9, "x\na\nb\nc\r\n d \n\nz", "en", "c", 18),
    (10, "a\nb\nc", "en", "c", 5), (11, "été \U0001f600   naïve", "fr", "é", 14),
    (12, "word " * 30_000, "en", "a", 150_000), (13, "one two", "en", "", 7), (-4, PROSE + " thirteen", "en", "b", 70),
    (14, "\x00 \x0b control \x1f", "en", "b", 12),
]


@pytest.fixture()
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture()
def clashing(odd):
    """With further columns, named like the operators' own."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture()
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
