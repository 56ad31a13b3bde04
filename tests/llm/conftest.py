"""Small frames with every awkward case, and what the tests of this folder share."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType()),
                     T.StructField("id", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture
def frame(spark):
    """``frame([(id, text), ...])``: documents with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y") for i, t in rows], DOCS)

    return make


@pytest.fixture
def awkward():
    line = "This line is found in many documents."
    return [(1, None), (2, ""), (3, " \t\n "), (4, line), (5, f"{line}\n{line}\nshort"), (6, f"  {line.upper()} \r\nown words of six"),
            (7, "word " * 30_000), (8, "x" * 20_000), (9, "日本語 русский Ünïcode ǅ ﬁ"), (9, "日本語 русский Ünïcode ǅ ﬁ"),
            (None, line), (None, None), (12, "a b"), (13, "A  B"), (14, "\u0000 nul \u0085 nel")]
