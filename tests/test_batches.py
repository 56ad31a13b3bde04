"""Python steps hold small batches of long texts, however large a partition is."""

import pytest
from pyspark.sql import functions as F

from folioworks.functions import markup
from folioworks.operators import chunking, pages
from folioworks.session import PARSED_ROWS, bounded_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "10000")
    yield spark
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("step", ["pages", "findings", "smart", "fixed"])
def test_parsing_steps_bound_their_batches(unset, step):
    rows = unset.createDataFrame([(1, "http://a.org/b", "<h1>Title</h1><p>Text of it.</p>")], "page_id long, url string, html string")
    docs = rows.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    made = {"pages": lambda: pages.parse(rows), "findings": lambda: rows.select(markup.findings(F.col("html")).alias("f")),
            "smart": lambda: chunking.smart_chunks(docs), "fixed": lambda: chunking.fixed_chunks(docs)}[step]()
    assert made.count() == 1
    assert int(unset.conf.get(KEY)) == PARSED_ROWS


def test_a_smaller_setting_stays(unset):
    unset.conf.set(KEY, "7")
    bounded_batches(unset)
    assert unset.conf.get(KEY) == "7"
